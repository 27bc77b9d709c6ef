"""The lexers and rules of the languages, in the notation of ``grammars``."""

from __future__ import annotations

import regex

_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\""
_CHAR = r"'(?:[^'\\\n]|\\[\s\S])*'"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_NESTED = r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/"  # comments in comments
_ID, _NUMBER = r"[^\W\d]\w*", r"\.?\d(?:[\w.]|(?<=[eEpP])[+-]|'(?=\w))*"

JAVA = {
    "lexer": rf'{_COMMENT}|"""[\s\S]*?"""|{_STRING}|{_CHAR}|{_ID}|\$[\w$]*|\.?\d(?:[\w.]|(?<=[eEpP])[+-])*|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<]=|<<=?|[-+*/%&|^]=|\S',
    "skip": _COMMENT, "literal": r"[\"'\d]|\.\d",
    "hard": "if else while do for try catch finally switch case default synchronized return throw break continue assert class interface enum extends implements throws new instanceof package import static final abstract public private protected native transient volatile strictfp void int long short byte char float double boolean",
    "rules": """
unit = (top)*
top = 'package' ID ('.' ID)* ';' | annotation+ 'package' ID ('.' ID)* ';' | 'import' 'static'? ID ('.' ID)* ('.' '*')? ';' | member | statement
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean'
dims = ('[' ']')*
named = ID targs? ('.' annotation* ID targs?)*
type = annotation* (prim | named) dims
types = type (',' type)*
targs = '<' (targ (',' targ)*)? '>'
targ = annotation* ('?' (('extends' | 'super') type)? | type)
annotation = '@' (! 'interface') ID ('.' ID)* ('(' (annarg (',' annarg)* ','?)? ')')?
annarg = ID '=' annval | annval
annval = '{' (annval (',' annval)*)? ','? '}' | annotation | ternary
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'transient' | 'volatile' | 'strictfp' | 'synchronized' (! '(') | 'default' (! (':' | '->')) | 'sealed' (= (ID | 'class' | 'interface' | 'abstract' | 'public')) | 'non' '-' 'sealed'
tparams = '<' annotation* ID ('extends' type ('&' type)*)? (',' annotation* ID ('extends' type ('&' type)*)?)* '>'
typedecl = modifier* ('class' ID tparams? ('extends' type)? ('implements' types)? ('permits' types)? body | 'interface' ID tparams? ('extends' types)? ('permits' types)? body | 'enum' ID ('implements' types)? enumbody | 'record' ID tparams? '(' params? ')' ('implements' types)? recordbody | '@' 'interface' ID body)
body = '{' member* '}'
recordbody = '{' (modifier* ID block | member)* '}'
enumbody = '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant = annotation* ID args? body?
member = ';' | typedecl | 'static'? block | modifier* tparams? annotation* (ID '(' params? ')' throwing? block | ('void' | type) ID (method | declared (',' ID declared)* ';'))
method = '(' params? ')' dims throwing? (block | ('default' annval)? ';')
declared = dims ('=' init)?
throwing = 'throws' types
params = param (',' param)*
param = ('final' | annotation)* type annotation* '...'? (ID '.')* ID dims
init = '{' (init (',' init)*)? ','? '}' | expr
block = '{' statement* '}'
statement = block | ';' | 'if' par statement ('else' statement)? | 'while' par statement | 'do' statement 'while' par ';' | 'for' '(' forhead ')' statement | 'try' ('(' resource (';' resource)* ';'? ')')? block catch* ('finally' block)? | 'switch' par switchbody | 'synchronized' par block | 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'assert' expr (':' expr)? ';' | ID ':' statement | typedecl | local ';' | 'yield' (! '=') expr ';' | expr ';'
par = '(' expr ')'
catch = 'catch' '(' ('final' | annotation)* type ('|' type)* ID ')' block
resource = local | expr
local = ('final' | annotation)* type ID declared (',' ID declared)*
forhead = ('final' | annotation)* type ID ':' expr | (local | exprs)? ';' expr? ';' exprs?
exprs = expr (',' expr)*
switchbody = '{' (('case' labels | 'default') ('->' (block | 'throw' expr ';' | expr ';') | ':' (! ':') statement*))* '}'
labels = label (',' label)* ('when' expr)?
label = 'default' | pattern | ternary
pattern = 'final'? type '(' (pattern (',' pattern)*)? ')' ID? (= (',' | '->' | ':' | 'when' | ')')) | 'final'? type ID
expr = lambda | ternary (assign expr)?
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '>'? '='
lambda = (ID | '(' (lparam (',' lparam)*)? ')') '->' (block | expr)
lparam = param | ID
ternary = binary ('?' expr ':' (lambda | ternary))?
binary = unary (binop unary | 'instanceof' 'final'? (pattern | type))*
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '<<' | '<' | '>' (! ('>' '>'? '=')) ('>' '>'?)? '='? | '+' | '-' | '*' | '/' | '%'
unary = ('+' | '-' | '++' | '--' | '!' | '~') unary | cast | postfix
cast = '(' prim dims ')' unary | '(' type ('&' type)* ')' (= (ID | LIT | '(' | '!' | '~' | 'new' | 'switch')) (lambda | unary)
postfix = primary suffix* ('++' | '--')*
suffix = '.' ('new' creator | 'class' | targs? ID args?) | '[' expr ']' | '::' targs? (ID | 'new')
primary = LIT | 'switch' par switchbody | 'new' creator | par | (prim | 'void') dims ('.' 'class' | '::' 'new') | named dims (= '::') | ID ('.' ID)* ('[' ']')+ '.' 'class' | ID args?
args = '(' exprs? ')'
creator = annotation* (prim | named) (('[' expr ']')+ dims | ('[' ']')+ init | args body?)
""",
}

_C_OPS = r"\.\.\.|->\*?|\+\+|--|&&|\|\||[=!<]=|<<=?|[-+*/%&|^]=|##|"
_C_WORDS = "if else while do for switch case default return break continue goto struct union enum sizeof typedef extern static inline register const volatile restrict void char short int long float double signed unsigned _Bool _Noreturn _Static_assert _Alignas _Atomic _Thread_local __attribute__ __declspec asm __asm__ __extension__"
_C_COMMON = """
par = '(' expr ')'
exprs = (expr | braced) (',' (expr | braced))*
braced = '{' (item (',' item)*)? ','? '}'
item = (('.' ID | '[' ternary ('...' ternary)? ']')+ '=' | ID ':')? (braced | assignment '...'?)
expr = assignment (',' assignment)*
assignment = ternary (assign (braced | assignment))?
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
ternary = binary ('?' expr? ':' assignment)?
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '<<' | '<' | '>' (! ('>' '=')) '>'? '='? | '+' | '-' | '*' | '/' | '%' | '->*'
attribute = '__attribute__' group | '__declspec' group | '_Alignas' group | 'asm' group | '__asm__' group
group = '(' (ANY | group | '[' (ANY | group)* ']' | '{' (ANY | group)* '}')* ')'
builtin = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | 'bool' | 'wchar_t'
block = '{' statement* '}'
"""
C = {
    "lexer": rf"{_COMMENT}|(?m:^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)|(?:u8|[LuU])?{_STRING}|(?:u8|[LuU])?{_CHAR}|{_ID}|{_NUMBER}|{_C_OPS}\S",
    "skip": _COMMENT + r"|[ \t]*\#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|error|line|warning|import)\b", "literal": r"(?:u8|[LuU])?[\"']|\d|\.\d", "constant": r"[A-Z_][A-Z0-9_]*\Z|Py\w*_(?:FUNC|DATA|BEGIN|END)\w*\Z",
    "hard": _C_WORDS,
    "rules": _C_COMMON + """
unit = external*
external = ';' | 'extern' LIT '{' external* '}' | '_Static_assert' group ';' | function | declaration | macro (= (MACRO | 'typedef' | 'static' | 'extern' | 'struct' | 'void' | builtin | ID ID) ) | statement | macro ';'? (! ANY) | macro
macro = MACRO group?
storage = 'typedef' | 'extern' | 'static' | 'inline' | 'register' | 'const' | 'volatile' | 'restrict' | '_Noreturn' | '_Atomic' group? | '_Thread_local' | '__extension__' | attribute | macro (= ('const' | 'static' | 'extern' | 'inline' | 'struct' | 'union' | 'enum' | builtin | ID | '*'+ ID group) )
specs = storage* (builtin (builtin | storage)* | tagged | ID (! ('=' | '.' | '->' | '[' | '+' | '-' | '++' | '--' | '?' | ':'))) ('const' | 'volatile' | 'restrict' | attribute | builtin)*
tagged = ('struct' | 'union') attribute* (ID? '{' field* '}' | ID) attribute* | 'enum' attribute* (ID? '{' (enumerator (',' enumerator)*)? ','? '}' | ID) attribute*
enumerator = ID attribute* ('=' ternary)?
field = ';' | '_Static_assert' group ';' | specs (fielddecl (',' fielddecl)*)? ';' | macro ';'?
fielddecl = declarator? ':' ternary attribute* | declarator attribute*
pointer = '*' ('const' | 'volatile' | 'restrict' | '_Atomic' | attribute | MACRO (= ID))*
declarator = pointer* attribute* (('(' attribute* MACRO? declarator ')' (= ('(' | '[' | ')' | ',' | ';' | '='))) | ID) trailer*
abstract = pointer* ('(' abstract ')' (= ('(' | '[')))? trailer*
trailer = '[' ('static' | 'const' | 'restrict')* ('*' (= ']') | assignment)? ']' | '(' params? ')'
params = param (',' param)* (',' '...')? | ID (',' ID)* | '...'
param = specs (declarator | abstract) attribute* (= (',' | ')')) | macro (= (',' | ')'))
declaration = specs (initial (',' initial)*)? ';'
initial = declarator (attribute | macro)* ('=' (braced | assignment))?
function = specs? pointer* functionname (attribute | macro)* (declaration)* block
functionname = '(' pointer* ID trailer* ')' trailer+ | (ID '(' params? ')') trailer* | ID trailer+
statement = block | ';' | 'if' par statement ('else' statement)? | 'while' par statement | 'do' statement 'while' par ';' | 'for' '(' (declaration | expr? ';') expr? ';' expr? ')' statement | 'switch' par statement | 'case' ternary ('...' ternary)? ':' | 'default' ':' | 'return' expr? ';' | 'goto' '*'? expr ';' | 'break' ';' | 'continue' ';' | ('asm' | '__asm__') 'volatile'? group ';' | attribute ';' | '_Static_assert' group ';' | ID ':' (! ':') | declaration | expr ';' | MACRO group statement
binary = unary (binop unary)*
unary = ('+' | '-' | '++' | '--' | '!' | '~' | '*' | '&' | '&&' | '__extension__') unary | 'sizeof' ('(' typename ')' (! '{') | unary) | cast | postfix
typename = specs abstract
cast = '(' typename ')' (braced postfixes | unary)
postfix = primary postfixes
postfixes = ('[' expr ']' | '(' arguments? ')' | '.' ID | '->' ID | '++' | '--')*
arguments = argument (',' argument)*
argument = assignment (= (',' | ')')) | typename
primary = LIT (LIT | MACRO)* | MACRO LIT+ | ID | '(' block ')' | par
""",
}
CPP = {
    "lexer": rf"{_COMMENT}|(?m:^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)|(?:u8|[LuU])?R\"(?P<tag>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=tag)\"|(?:u8|[LuU])?{_STRING}|(?:u8|[LuU])?{_CHAR}|{_ID}|{_NUMBER}|::|<=>|{_C_OPS}\S".replace("(?P<tag>[^()\\\\\\s]{0,16})", "").replace("(?P=tag)", ""),
    "skip": C["skip"], "literal": r"(?:u8|[LuU])?R?[\"']|\d|\.\d", "constant": r"[A-Z_][A-Z0-9_]+\Z",
    "hard": _C_WORDS.replace("_Bool", "bool wchar_t") + " auto class namespace using template typename operator new delete public private protected virtual explicit constexpr consteval constinit mutable noexcept friend thread_local try catch throw decltype static_assert alignas co_return co_await co_yield concept requires",
    "rules": _C_COMMON + """
unit = external*
external = ';' | 'extern' LIT ('{' external* '}' | external) | 'inline'? 'namespace' attr* (ID ('::' ID)*)? ('{' external* '}' | '=' qname ';') | 'template' tparams requiring? external | 'template' external | 'using' using ';' | assertion | 'concept' ID '=' expr ';' | access | method | declaration | macro (= (MACRO | 'class' | 'struct' | 'void' | builtin | 'namespace' | 'template' | ID ID)) | statement | macro
assertion = ('static_assert' | '_Static_assert') group ';'
using = 'namespace' qname | ID attr* '=' typename | 'typename'? qname '...'? (',' 'typename'? qname)*
access = ('public' | 'private' | 'protected') ID? ':'
macro = MACRO group?
attr = '[' '[' (ANY | group)* ']' ']' | attribute | 'alignas' group
tparams = '<' (tparam (',' tparam)*)? '>'
tparam = ('template' tparams)? ('class' | 'typename') '...'? ID? ('=' typename)? (= (',' | '>')) | specs '...'? (declarator | abstract) ('=' tvalue)?
tvalue = unary (tbinop unary)*
tbinop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '<<' | '+' | '-' | '*' | '/' | '%'
requiring = 'requires' ('(' expr ')' | qname | '&&' | '||')+
targs = '<' (targ (',' targ)*)? '>'
targ = typename '...'? (= (',' | '>')) | tvalue '...'?
part = '~'? ID targs? | 'operator' opname
qname = '::'? part ('::' 'template'? part)*
opname = 'new' ('[' ']')? | 'delete' ('[' ']')? | '(' ')' | '[' ']' | 'co_await' | '->*' | '->' | '<=>' | ',' | '++' | '--' | '!' | '~' | '=' | assign | binop | LIT ID? | specs pointer*
storage = 'typedef' | 'extern' LIT? | 'static' | 'inline' | 'register' | 'const' | 'volatile' | 'restrict' | 'virtual' | 'explicit' group? | 'constexpr' | 'consteval' | 'constinit' | 'mutable' | 'friend' | 'thread_local' | '__extension__' | attr | macro (= ('const' | 'static' | 'inline' | 'virtual' | 'constexpr' | 'class' | 'struct' | builtin | ID))
specs = storage* (builtin (builtin | storage)* | 'auto' | 'decltype' group | 'typename' qname | tagged | qname) ('const' | 'volatile' | attr | builtin | 'constexpr' | 'static' | 'inline')*
tagged = ('struct' | 'union' | 'class') (attr | macro (= ID))* (qname? 'final'? (':' base (',' base)*)? '{' member* '}' | qname) | 'enum' ('class' | 'struct')? attr* qname? (':' specs)? ('{' (enumerator (',' enumerator)*)? ','? '}')?
base = ('public' | 'private' | 'protected' | 'virtual')* qname '...'?
enumerator = ID attr* ('=' ternary)?
member = ';' | access | 'template' tparams requiring? member | 'using' using ';' | assertion | 'friend' ('class' | 'struct') qname ';' | method | specs (fielddecl (',' fielddecl)*)? ';' | macro ';'?
fielddecl = (declarator? ':' ternary | declarator) attr* ('=' (braced | assignment) | braced)?
pointer = ('*' | '&&' | '&' | qname '::' '*') ('const' | 'volatile' | 'restrict' | attr)*
declarator = pointer* attr* '...'? ('(' declarator ')' (= ('(' | '[' | ')' | ',' | ';' | '=' | '{')) | qname) trailer*
abstract = pointer* '...'? ('(' abstract ')' (= ('(' | '[')))? trailer*
trailer = '[' ternary? ']' | '(' params? ')' qualifier*
qualifier = 'const' | 'volatile' | '&&' | '&' | 'noexcept' group? | 'override' | 'final' | 'throw' group | '->' typename | attr | macro (= (';' | '{' | 'const' | 'override'))
params = param (',' param)* (','? '...')? | '...'
param = specs (declarator | abstract) attr* ('=' (braced | assignment))? (= (',' | ')' | '...')) | macro (= (',' | ')'))
declaration = specs ('[' ID (',' ID)* ']' '=' assignment | pointer* '[' ID (',' ID)* ']' ('=' (braced | assignment) | braced | par) | initial (',' initial)*)? ';'
initial = declarator attr* ('=' (braced | assignment) | braced | '(' exprs? ')')?
method = specs? pointer* qname trailer+ requiring? (':' meminit (',' meminit)*)? ('try'? block catch* | '=' ('default' | 'delete' | LIT) ';' | (= ';') ';') | storage* qname '(' params? ')' qualifier* (':' meminit (',' meminit)*)? ('try'? block catch* | '=' ('default' | 'delete' | LIT) ';' | ';') | storage* 'operator' specs pointer* trailer+ (block | '=' ('default' | 'delete') ';' | ';') | specs pointer* '(' pointer* qname trailer* ')' trailer+ block
meminit = qname ('(' exprs? ')' | braced) '...'?
catch = 'catch' '(' ('...' | specs (declarator | abstract)) ')' block
condition = '(' (declaration)? (specs declarator ('=' (braced | assignment) | braced) | expr) ')' | '(' expr ';' expr ')'
statement = block | ';' | attr* 'if' 'constexpr'? condition statement ('else' statement)? | 'while' condition statement | 'do' statement 'while' par ';' | 'for' '(' forhead ')' statement | 'switch' condition statement | 'case' ternary ('...' ternary)? ':' | 'default' ':' | 'return' (expr | braced)? ';' | 'co_return' (expr | braced)? ';' | 'goto' ID ';' | 'break' ';' | 'continue' ';' | 'try' block catch+ | ('asm' | '__asm__') 'volatile'? group ';' | 'using' using ';' | 'namespace' ID '=' qname ';' | assertion | attr+ ';' | ID ':' (! ':') | expression | declaration | expr ';' | MACRO group statement
expression = ID group ';' | qname group (('.' | '->') qname group)* ';'
forhead = declaration? specs (pointer* '[' ID (',' ID)* ']' | declarator) ':' (braced | expr) | (declaration | expr? ';') expr? ';' expr?
binary = unary (binop unary | '<=>' unary | '...')*
unary = ('+' | '-' | '++' | '--' | '!' | '~' | '*' | '&&' | '&' | 'co_await') unary | 'sizeof' '...'? ('(' typename ')' | unary) | 'throw' assignment? | 'co_yield' assignment | '::'? 'new' group? creator | '::'? 'delete' ('[' ']')? unary | cast | postfix
creator = specs pointer* ('[' expr ']')* ('(' exprs? ')' | braced)? | '(' typename ')' ('(' exprs? ')' | braced)?
typename = specs abstract
cast = '(' typename ')' (= (ID | LIT | '(' | '*' | '&' | '-' | '~' | '!' | '::' | 'new' | 'sizeof' | '{')) (braced postfixes | unary)
postfix = primary postfixes
postfixes = ('[' (expr | braced)? ']' | '(' arguments? ')' | ('.' | '->') 'template'? (qname | '~' ID) | '++' | '--' | braced)*
arguments = argument (',' argument)*
argument = (braced | assignment) '...'? (= (',' | ')')) | typename
primary = LIT (LIT | MACRO)* ID? | lambda | '(' assignment ',' '...' ')' | '(' '...' binop unary ')' | '(' unary binop '...' (binop unary)? ')' | '(' block ')' | '(' expr ')' | 'noexcept' group | 'decltype' group | 'requires' group? '{' (ANY | group | '{' (ANY | group)* '}')* '}' | ('typename' qname | builtin+ | 'auto') (= ('(' | '{')) | calledname | qname targs (= ('(' | '{' | '::')) | name
calledname = '::'? ID targs ('::' 'template'? part)* (= ('(' | '{' | ')' | ';' | ',' | '.')) | '::'? ID '::' qname
name = '::'? (ID | 'operator' opname) ('::' part)*
lambda = '[' (capture (',' capture)*)? ']' tparams? ('(' params? ')')? ('mutable' | 'constexpr' | 'noexcept' group? | attr)* ('->' typename)? block
capture = ('=' | '&' | '*')? ID? '...'? ('=' assignment | braced)?
""",
}

RUST = {
    "lexer": rf"{_NESTED}|b?c?r\#+\"[\s\S]*?\"\#+|[bc]?r?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))'|'[^\W\d]\w*|r\#{_ID}|{_ID}|\d(?:\w|\.(?=\d)|(?<=[eE])[+-])*(?:\.(?![.\w]))?|\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||[=!<]=|<<=?|[-+*/%&|^]=|\S",
    "skip": _NESTED, "literal": r"[bc]?r?\#*\"|b?'(?:[^'\\\n]|\\.+)'\Z|\d", "lifetime": r"'\w+\Z",
    "hard": "if else match loop while for in return break continue fn struct enum trait impl let use pub mut ref const static unsafe async await move dyn extern where as mod type crate box yield",
    "rules": """
unit = innerattr* blockitem*
innerattr = '#' '!' '[' tree* ']'
attr = '#' '[' tree* ']'
tree = ANY | '(' tree* ')' | '[' tree* ']' | '{' tree* '}'
visible = 'pub' ('(' ('in'? path | 'crate') ')')? | 'crate' (! '::')
path = '::'? segment ('::' segment)*
segment = (ID | 'crate') ('::'? targs | '(' types? ')' ('->' bounded)?)?
exprpath = '::'? (ID | 'crate') ('::' (targs | ID))*
targs = '<' (targ (',' targ)*)? ','? '>'
targ = LIFETIME | ID targs? '=' bound | ID ':' bounds | ('{' tree* '}' | '-'? LIT) | bound
types = bound (',' bound)* ','?
bound = ('impl' | 'dyn')? bounds
bounded = ('impl' | 'dyn')? bounds
bounds = one ('+' one)* '+'?
one = LIFETIME | '?'? ('for' targs)? type | '(' '?' type ')'
type = '(' types? ')' | '[' bound (';' expr)? ']' | '!' | '_' | '*' ('const' | 'mut') type | ('&&' | '&') LIFETIME? 'mut'? ('dyn' | 'impl')? type | '<' bound ('as' path)? '>' ('::' segment)+ | 'unsafe'? ('extern' LIT?)? 'fn' '(' (fnarg (',' fnarg)*)? ','? ')' ('->' bound)? | ('dyn' | 'impl') bounds | path ('!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}'))?
fnarg = '...' | (ID ':')? bound
generics = '<' (generic (',' generic)*)? ','? '>'
generic = attr* (LIFETIME (':' (LIFETIME ('+' LIFETIME)*)?)? | 'const' ID ':' bound ('=' targ)? | ID (':' bounds?)? ('=' bound)?)
where = 'where' (((LIFETIME | 'for' targs bound | bound) ':' bounds?) (',' (= (! '{') ANY))?)* ','?
fnqual = 'const' | 'async' | 'unsafe' | 'extern' LIT? | 'default'
function = fnqual* 'fn' ID generics? '(' (param (',' param)*)? ','? ')' ('->' bound)? where? (block | ';')
param = attr* ('...' | ('&' LIFETIME?)? 'mut'? 'self' (':' bound)? | pattern ':' bound)
item = attr* visible? (function | 'struct' ID generics? (where? fields | '(' (tuplefield (',' tuplefield)*)? ','? ')' where? ';' | ';') | 'union' ID generics? where? fields | 'enum' ID generics? where? '{' (variant (',' variant)*)? ','? '}' | ('unsafe' | 'auto')* 'trait' ID generics? (':' bounds?)? where? '{' associated* '}' | 'default'? 'unsafe'? 'impl' (generics (! '::'))? ('!'? bounded 'for')? bounded where? '{' innerattr* associated* '}' | 'use' usetree ';' | 'extern' 'crate' ID ('as' ID)? ';' | 'mod' ID (';' | '{' innerattr* item* '}') | 'unsafe'? 'extern' LIT? '{' associated* '}' | 'static' 'mut'? ID ':' bound ('=' expr)? ';' | 'const' (ID | '_') ':' bound ('=' expr)? ';' | 'default'? 'type' ID generics? (':' bounds?)? where? ('=' bound where?)? ';' | 'macro_rules' '!' ID ('{' tree* '}' | '(' tree* ')' ';') | macro ';' | macrobraces)
associated = item
fields = '{' (field (',' field)*)? ','? '}'
field = attr* visible? ID ':' bound
tuplefield = attr* visible? bound
variant = attr* visible? ID (fields | '(' (tuplefield (',' tuplefield)*)? ','? ')')? ('=' expr)?
usetree = '::'? (('crate' | ID) ('::' ('crate' | ID))* ('::' ('*' | '{' (usetree (',' usetree)*)? ','? '}') | 'as' (ID | '_'))? | '*' | '{' (usetree (',' usetree)*)? ','? '}')
pattern = '|'? patternone ('|' patternone)*
patternone = attr* ('&&' | '&') 'mut'? patternone | ('..=' | '..') (= (LIT | '-' | ID)) patternend | '..' | macro | '-'? LIT patternrange? | '(' (pattern (',' pattern)*)? ','? ')' | '[' (pattern (',' pattern)*)? ','? ']' | 'box' patternone | ('ref' | 'mut')+ ID ('@' patternone)? | 'const' block | '_' | ID '@' patternone | exprpath patternrange | '<' bound ('as' path)? '>' ('::' segment)+ | exprpath ('(' (pattern (',' pattern)*)? ','? ')' | '{' (patternfield (',' patternfield)*)? ','? '}')?
patternend = '-'? LIT | exprpath
patternrange = ('..=' | '...' | '..') (patternend)?
patternfield = attr* ('..' | ('ref' | 'mut')* (ID | LIT) (':' pattern)?)
block = '{' innerattr* blockitem* tail? '}'
blockitem = ';' | attr* 'let' pattern (':' bound)? ('=' expr ('else' block)?)? ';' | (= (attr | 'pub' | 'fn' | 'struct' | 'enum' | 'impl' | 'trait' | 'use' | 'mod' | 'static' | 'type' | 'const' | 'unsafe' | 'async' | 'extern' | 'union' | 'macro_rules' | 'default')) item | attr* (blocklike (! ('.' | '?')) ';'? | expr ';' | macrobraces (! ('.' | '?' | '=')))
tail = attr* expr
blocklike = (LIFETIME ':')? ('if' condition block ('else' 'if' condition block)* ('else' block)? | 'match' noblock '{' innerattr* arm* '}' | 'loop' block | 'while' condition block | 'for' pattern 'in' noblock block | block) | 'unsafe' block | 'const' block | 'async' 'move'? block
condition = chained ('&&' chained)*
chained = 'let' pattern '=' letvalue | noblock
letvalue = (! 'let') nunary ((! ('&&' | '||')) binop nunary | 'as' type)*
arm = attr* pattern ('if' condition)? '=>' (blocklike (! ('.' | '?' | binop | '(')) ','? | expr (',' | (= '}')))
macro = macropath '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}')
macropath = '::'? (ID | 'crate') ('::' (ID | 'crate'))*
macrobraces = macropath '!' '{' tree* '}'
expr = ('return' | 'break' LIFETIME?) expr? | 'continue' LIFETIME? | 'yield' expr? | closure | range (assign expr)?
assign = '=' (! '=') | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
range = ('..=' | '..') binary? | binary (('..=' | '..') binary?)?
binary = unary (binop (closure | unary) | 'as' type)*
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '<<' | '<' | '>' (! ('>' '=')) '>'? '='? | '+' | '-' | '*' | '/' | '%'
unary = ('-' | '!' | '*') unary | ('&&' | '&') ('raw' ('const' | 'mut'))? 'mut'? (closure | unary) | ('return' | 'break' LIFETIME?) expr? | 'continue' LIFETIME? | postfix
postfix = primary post*
post = '.' ('await' | LIT | ID ('::' targs)?) | '(' (attr* expr (',' attr* expr)*)? ','? ')' | '[' expr ']' | '?'
primary = blocklike | LIT | macro | '(' attr* (expr (',' expr)*)? ','? ')' | '[' (expr ';' expr | (attr* expr (',' attr* expr)*)? ','?) ']' | closure | '<' bound ('as' path)? '>' ('::' segment)+ | exprpath ('{' (value (',' value)*)? (','? '..' expr?)? ','? '}' (! 'else'))? | '_'
value = attr* (ID | LIT) (':' expr)?
closure = ('for' targs)? 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)*)? ','? '|') ('->' bound block | expr)
cparam = attr* patternone (':' bound)?
noblock = closure | nrange (assign noblock)?
nrange = ('..=' | '..') nbinary? | nbinary (('..=' | '..') nbinary?)?
nbinary = nunary (binop nunary | 'as' type)*
nunary = ('-' | '!' | '*') nunary | ('&&' | '&') 'mut'? nunary | nprimary post*
nprimary = (! '{') (= (LIFETIME | 'if' | 'match' | 'loop' | 'while' | 'unsafe' | 'async' | 'for')) blocklike | LIT | macro | '(' (expr (',' expr)*)? ','? ')' | '[' (expr ';' expr | (expr (',' expr)*)? ','?) ']' | closure | ('return' | 'break' LIFETIME?) noblock? | '<' bound ('as' path)? '>' ('::' segment)+ | exprpath | '_'
""",
}

GO = {
    "lexer": rf"{_COMMENT}|{_STRING}|{_CHAR}|`[^`]*`|{_ID}|{_NUMBER}|\n|\.\.\.|<-|:=|\+\+|--|&&|\|\||&\^=?|[=!<>]=|<<=?|>>=?|[-+*/%&|^]=|\S",
    "skip": _COMMENT, "literal": r"[\"'`\d]|\.\d",
    "hard": "package import func type struct interface map chan var const if else for range switch select case default return break continue fallthrough goto go defer",
    "ends": ("ID LIT return break continue fallthrough ++ -- ) ] }", ""),
    "rules": """
unit = (end | top)*
end = ';' | N
close = end | (= ('}' | ')')) | (! ANY) (! ('(' | '[' | '{'))
top = 'package' ID close | 'import' (spec | '(' (spec end)* spec? ')') close | 'func' receiver? ID tparams? signature block? close | statement
spec = (ID | '.')? LIT
receiver = '(' (ID (! ('.' | '[' | ')')))? '*'? ID ('[' ID (',' ID)* ']')? ')'
tparams = '[' tparam (',' tparam)* ','? ']'
tparam = ID (',' ID)* constraint
constraint = '~'? type ('|' '~'? type)*
signature = '(' params? ')' (result)?
result = '(' params? ')' | type
params = param (',' param)* ','?
param = ID '...'? type | '...' type | type
type = named | '(' type ')' | '*' type | '[' (('...' | expr)? ']') type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' signature | 'struct' '{' (field end)* field? '}' | 'interface' '{' (method end)* method? '}'
named = ID ('.' ID)? ('[' type (',' type)* ','? ']')?
field = ID (',' ID)* type LIT? | '*'? named LIT?
method = ID '(' params? ')' result? | constraint
typespec = ID (tparams)? '='? type
varspec = ID (',' ID)* (type ('=' exprs)? | '=' exprs)
constspec = ID (',' ID)* type? ('=' exprs)?
block = '{' body '}'
body = (end | statement)*
statement = ('var' (varspec | '(' (end | varspec (end | (= ')')))* ')') | 'const' (constspec | '(' (end | constspec (end | (= ')')))* ')') | 'type' (typespec | '(' (end | typespec (end | (= ')')))* ')') | block | 'if' (nsimple? ';')? nexpr block (else)? | 'for' forhead? block | 'switch' (nsimple? ';')? ((ID ':=')? nprimary '.' '(' 'type' ')' | nsimple)? '{' N? clause* '}' | 'select' '{' comm* '}' | 'return' exprs? | ('break' | 'continue' | 'goto') ID? | 'fallthrough' | ('go' | 'defer') expr | simple) close | ID ':' N?
else = 'else' ('if' (nsimple? ';')? nexpr block else? | block)
forhead = (nexprs ('=' | ':='))? 'range' nexpr | nsimple? ';' nexpr? ';' nsimple? | nexpr
clause = ('case' (expr | type) (',' (expr | type))* | 'default') ':' body
comm = ('case' simple | 'default') ':' body
simple = exprs (assign exprs | '++' | '--' | '<-' expr)?
assign = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
exprs = expr (',' expr)*
expr = unary (binop unary)*
binop = '||' | '&&' | '==' | '!=' | '<=' | '>=' | '<<' | '>>' | '<' | '>' | '+' | '-' | '*' | '/' | '%' | '&^' | '&' | '|' | '^'
unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | primary
primary = operand post*
post = '.' (ID | '(' (type | 'type') ')') | index | '(' (arg (',' arg)* '...'? ','?)? ')' | literal
index = '[' (expr? ':' expr? (':' expr)? | (type | expr) (',' type)* ','?) ']'
arg = expr (= (',' | ')' | '...')) | type
operand = LIT | 'func' signature block | (= ('[' | 'map' | 'struct' | 'chan' | '*' | 'interface')) type (= ('{' | '(')) | ID | '(' (expr | type) ')'
literal = '{' (element (',' element)* ','?)? '}'
element = (literal | expr) (':' (literal | expr))?
nsimple = nexprs (assign nexprs | '++' | '--' | '<-' nexpr)?
nexprs = nexpr (',' nexpr)*
nexpr = nunary (binop nunary)*
nunary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') nunary | nprimary
nprimary = noperand npost*
npost = '.' (! ('(' 'type' ')')) (ID | '(' type ')') | index | '(' (arg (',' arg)* '...'? ','?)? ')'
noperand = LIT | 'func' signature block | (= ('[' | 'map')) type (literal | (= '(')) | ID | '(' (expr | type) ')'
""",
}

_JSX = regex.compile(
    r"<(?:[A-Za-z][\w.:-]*(?:<[^<>()]*>)?(?&attrs)(?:/>|>(?:[^<>{}]|(?&code))*+</[\w.:-]+\s*>)|>(?:[^<>{}]|(?&code))*+</>)"
    r"(?(DEFINE)(?P<attrs>(?:\s+(?:[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?&code)))?|(?&code)))*+\s*+)(?P<code>\{(?:[^{}\"'`]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|(?&code))*+\}))"
)


def _without_jsx(text: str) -> str:
    """Elements of JSX as literals, the innermost first; code inside them is only balanced."""
    found = "</" in text or "/>" in text
    while found:
        text, found = _JSX.subn('""', text)
    return text


_TEMPLATE = regex.compile(r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?P<code>(?:[^{}`\"']|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\{(?&code)\}|(?R))*+)\})*+`")


def _without_templates(text: str) -> str:
    """Template strings with code in them as plain ones; that code is only balanced."""
    return _TEMPLATE.sub(lambda m: "``" + "\n" * m.group().count("\n") if "${" in m.group() else m.group(), text) if "${" in text else text


_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n+])|(?<=[=(,:;!&|?{}\[+] )|(?<=return )|(?<=typeof )|(?<=^))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_SCRIPT_END = "ID LIT this super null true false ) ] } ++ -- return break continue"
_SCRIPT_NEXT = ". ?. , ; ) ] } : ? = + - * / % & | ^ && || ?? == != === !== < > <= >= << => ( [ in of instanceof as satisfies extends implements else catch finally += -= *= /= %= &= |= ^= ??= ||= &&= ** **="
_SCRIPT_HARD = "if else while do for switch case default return throw break continue debugger try catch finally var let const function class extends new typeof void delete await yield in instanceof import export with this super null true false"
_SCRIPT_RULES = """
unit = (statement | N)* finish | (N | ';' | memberfunction)* finish
finish = (! ANY) (! ('(' | '[' | '{' | ')' | ']' | '}'))
eos = ';' | N | (= '}') | (! ANY) (! ('(' | '[' | '{'))
n = N?
par = '(' expr ')' n
body = n statement
block = '{' (statement | N)* '}'
statement = block | ';' | 'if' par statement ((N | ';')? 'else' n statement)? | 'while' par statement | 'do' n statement n 'while' '(' expr ')' eos? | 'for' 'await'? '(' forhead ')' n statement | 'try' block n ('catch' ('(' target ')')? block n)? ('finally' block)? | 'switch' par '{' N? clause* '}' | 'return' (expr)? eos | 'throw' expr eos | ('break' | 'continue') ID? eos | 'debugger' eos | 'with' par statement | LABEL statement | declaration | import eos | export | expr eos
LABEL = ID ':' n (! ')')
clause = ('case' expr | 'default') ':' (statement | N)*
forhead = ('var' | 'let' | 'const') target ('of' | 'in') expr | lhs ('of' | 'in') expr | (variables | expr)? ';' expr? ';' expr?
lhs = unary
variables = ('var' | 'let' | 'const' | 'using') variable (',' variable)*
property = ID | LIT | word | '#' name | '[' assignment ']'
name = ID | word
word = 'if' | 'else' | 'while' | 'do' | 'for' | 'switch' | 'case' | 'default' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'try' | 'catch' | 'finally' | 'var' | 'let' | 'const' | 'function' | 'class' | 'extends' | 'new' | 'typeof' | 'void' | 'delete' | 'await' | 'yield' | 'in' | 'instanceof' | 'import' | 'export' | 'with' | 'this' | 'super' | 'null' | 'true' | 'false'
bound = ID | '[' (','* element)* (','* '...' target)? ','* ']' | '{' (part (',' part)*)? ','? '}'
element = target ('=' assignment)? (= (',' | ']'))
part = '...' target | property ':' target ('=' assignment)? | ID ('=' assignment)?
import = 'import' ('type' (= ('{' | '*' | ID (! 'from'))))? (LIT | clauseimport 'from' LIT) (('with' | 'assert') object)?
clauseimport = ID (',' (names | '*' 'as' ID))? | names | '*' 'as' ID
names = '{' (N? ('type' (= ID (! 'as') | ID 'as' ID | 'default'))? (name | LIT) ('as' (name | LIT))? N? (',' N? ('type' (= ID))? (name | LIT) ('as' (name | LIT))? N?)*)? ','? '}'
exprs = assignment (',' assignment)*
expr = assignment (',' assignment)*
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '>'? '=' | '**=' | '??=' | '||=' | '&&='
assignment = arrow | 'yield' ('*'? assignment)? | ternary (assignop assignment)?
ternary = binary ('?' assignment ':' assignment)?
binop = '??' | '||' | '&&' | '|' | '^' | '&' | '===' | '!==' | '==' | '!=' | '<=' | '<<' | '<' | '>' (! ('>' '>'? '=')) ('>' '>'?)? '='? | '+' | '-' | '**' | '*' | '/' | '%' | 'in' | 'instanceof'
unaryop = '+' | '-' | '++' | '--' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await'
args = '(' (arg (',' arg)*)? ','? ')'
arg = '...'? assignment
primary = LIT | 'this' | 'super' | 'null' | 'true' | 'false' | '#' ID (= 'in') | 'async' 'function' '*'? ID? function | 'function' '*'? ID? function | decorator* 'class' classtail | 'new' '.' ID | 'new' newexpr | 'import' ('.' ID | args) | '(' expr ')' | '[' (','* arg)? (','+ arg)* ','* ']' | object | ID
newexpr = 'new' newexpr | primary newpost* targs? args?
newpost = '.' ('#'? name) | '[' expr ']' | LIT
object = '{' (entry (',' entry)*)? ','? '}'
entry = '...' assignment | methodmods property method | property ':' assignment | ID ('=' assignment)?
methodmods = ('async' (= ('*' | property)) (! ('async' ('(' | ':' | ',' | '}' | '<' | '='))))? '*'? (('get' | 'set') (= property))?
decorator = '@' (ID ('.' name)* args? | '(' expr ')') n
"""
JAVASCRIPT = {
    "lexer": rf"{_COMMENT}|\#!.*|{_REGEX}|{_STRING}|{_CHAR}|`(?:[^`\\]|\\[\s\S])*`|[^\W\d][\w$]*|\$[\w$]*|{_NUMBER}|\n|\.\.\.|=>|\?\?=?|\?\.(?!\d)|===|!==|\*\*=?|\+\+|--|&&=?|\|\|=?|[=!<]=|<<=?|[-+*/%&|^]=|\S",
    "skip": _COMMENT + r"|\#!.", "literal": r"[\"'`\d]|\.\d|/.",
    "hard": _SCRIPT_HARD, "ends": (_SCRIPT_END, _SCRIPT_NEXT), "prepare": lambda text: _without_templates(_without_jsx(text)),
    "rules": _SCRIPT_RULES + """
targs = (! N) 'none'
target = bound
variable = bound ('=' assignment)?
declaration = variables eos | 'async'? 'function' '*'? ID function | decorator* 'class' ID classtail
export = decorator* 'export' ('default' (('async'? 'function' '*'? ID? function | decorator* 'class' classtail) | assignment eos) | '*' ('as' name)? 'from' LIT eos | names ('from' LIT)? eos | declaration)
function = '(' (param (',' param)*)? ','? ')' block
param = decorator* ('...' bound | bound ('=' assignment)?)
arrow = 'async'? (ID | '(' (param (',' param)*)? ','? ')') '=>' (block | assignment)
classtail = (! 'extends') ID? classbody | ID? 'extends' unary classbody
classbody = '{' (N | ';' | member)* '}'
memberfunction = decorator* ('static' (= ('async' | '*' | 'get' | 'set' | property)))? methodmods property method
member = decorator* ('static' block | ('static' (= ('async' | '*' | 'get' | 'set' | property)) (! ('static' ('(' | '=' | ';'))))? (methodmods property method | property ('=' assignment)? eos))
method = '(' (param (',' param)*)? ','? ')' block
binary = unary (binop unary)*
unary = unaryop unary | postfix
postfix = primary post* ('++' | '--')?
post = '.' '#'? name | '?.' ('[' expr ']' | args | '#'? name) | '[' expr ']' | args | LIT
""",
}
TYPESCRIPT = JAVASCRIPT | {
    "rules": _SCRIPT_RULES + """
targs = '<' type (',' type)* ','? '>'
tparams = '<' tparam (',' tparam)* ','? '>'
tparam = ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
type = ('asserts' ID ('is' type)?) | ID 'is' type | 'this' 'is' type | conditional
conditional = union ('extends' (! ID? '{') union ('?' type ':' type))?
union = '|'? intersection ('|' intersection)*
intersection = '&'? prefixed ('&' prefixed)*
prefixed = ('keyof' | 'unique' | 'readonly') (= (ID | '(' | '[' | '{' | 'typeof' | 'this')) prefixed | 'infer' ID ('extends' prefixed (! '?'))? | postfixed
postfixed = simple ('[' type? ']')*
simple = functype | '(' type ')' | '[' (tuple (',' tuple)*)? ','? ']' | mapped | '{' (N | ';' | ',' | tmember)* '}' | 'typeof' ('import' args | ID | 'this') ('.' name)* targs? | 'import' args ('.' name)* targs? | '-'? LIT | 'void' | 'null' | 'true' | 'false' | 'this' | 'new' functype | ID ('.' name)* targs?
functype = ('abstract'? 'new')? tparams? '(' (param (',' param)*)? ','? ')' '=>' type
tuple = '...'? (ID '?'? ':' (! ':'))? type '?'?
mapped = '{' N? (('+' | '-')? 'readonly')? '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? (';' | N)? '}'
tmember = 'new'? tparams? '(' (param (',' param)*)? ','? ')' (':' type)? tend | 'readonly'? '[' ID ':' type ']' ':' type tend | (('get' | 'set') (= property))? ('readonly' (= property (! '(')))? property '?'? (tparams? '(' (param (',' param)*)? ','? ')' (':' type)? | ':' type)? tend
tend = ';' | ',' | N | (= '}')
note = ':' type
target = bound note?
variable = bound '!'? note? ('=' assignment)?
declaration = 'declare' (= ('var' | 'let' | 'const' | 'function' | 'class' | 'abstract' | 'enum' | 'const' | 'namespace' | 'module' | 'global' | 'type' | 'interface')) declaration | 'const' 'enum' ID enum | variables eos | 'async'? 'function' '*'? ID (function | signature eos) | decorator* 'abstract'? 'class' ID classtail | 'interface' ID tparams? ('extends' type (',' type)*)? '{' (N | ';' | ',' | tmember)* '}' | 'type' ID tparams? '=' type eos | 'enum' ID enum | ('namespace' | 'module') (LIT | ID ('.' ID)*) (block | eos) | 'global' block
enum = '{' (enumerator (',' enumerator)*)? ','? '}'
enumerator = N? (name | LIT) ('=' assignment)? N?
export = decorator* 'export' ('default' (('async'? 'function' '*'? ID? function | decorator* 'abstract'? 'class' classtail | 'interface' declaration) | assignment eos) | 'type'? ('*' ('as' name)? 'from' LIT eos | names ('from' LIT)? eos) | '=' expr eos | 'import' ID '=' expr eos | decorator* declaration)
signature = tparams? '(' (param (',' param)*)? ','? ')' note?
function = signature block
param = decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')* ('...' bound note? | ('this' | bound) '?'? note? ('=' assignment)?) (= (',' | ')')) | decorator* ('...' bound note? | ('this' | bound) '?'? note? ('=' assignment)?)
arrow = 'async'? (ID | tparams? '(' (param (',' param)*)? ','? ')' (note)?) '=>' (block | assignment)
heritage = ('extends' postfix targs?)? ('implements' type (',' type)*)?
classtail = ((! ('extends' | 'implements')) ID)? tparams? heritage classbody
classbody = '{' (N | ';' | member)* '}'
modifier = ('public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor') (= (property | 'async' | '*' | '{'))
memberfunction = decorator* modifier* methodmods property '?'? signature (block | eos)
member = decorator* (modifier (! ('=' | ':' | '(' | ';' | '?' | '!')))* ('{' (statement | N)* '}' | methodmods property '?'? (signature (block | eos)) | '[' ID ':' type ']' ':' type eos | property ('?' | '!')? note? ('=' assignment)? eos)
method = signature block
binary = unary (binop unary | ('as' | 'satisfies') ('const' | type))*
unary = unaryop unary | '<' ('const' | type) '>' unary | postfix
postfix = primary post* ('++' | '--')?
post = '.' '#'? name | '?.' ('[' expr ']' | targs? args | '#'? name) | '[' expr ']' | args | LIT | targs (= ('(' | ')' | ',' | ';' | LIT | N | ']' | ':')) | '!' (! '=')
""",
}
