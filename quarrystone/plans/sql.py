"""DuckDB SQL with the same results as the registered queries of the core."""

from __future__ import annotations

from ..functions.text import DISPLAY_LANGUAGES, PARSED_LANGUAGES

_LIVE = "(select * from symbols where gone_at is null)"
_FILES = "(select path, max(struct_pack(a := indexed_at, b := sha256)).b as sha256, max(indexed_at) as indexed_at from files where path is not null group by path)"
_WHOLE = """(with c as (select distinct id, path, kind, line_start, symbol, parent, source, body_sha256 from chunks where path is not null and source is not null),
 w as (select path, arg_min(source, id) as source, arg_min(body_sha256, id) as sha256 from c where kind = 'file' group by path),
 p as (select path, string_agg(source, chr(10) order by line_start, id) as source from c where kind <> 'file' and (kind <> 'method' or parent is null
  or not exists (select 1 from c k where k.path = c.path and k.kind <> 'method' and k.symbol = c.parent)) group by path)
 select * from w union all select path, source, sha256(source) from p where path not in (select path from w))"""
_NEWEST = "(select path, max(struct_pack(a := changed_at, b := change_id, c := status)).c as status from file_changes where path is not null group by path)"
_LANG = "case lower(regexp_extract(path, '([^.]*)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in DISPLAY_LANGUAGES.items()) + " else 'Other' end"
_DIR = "split_part(path, '/', 1)"
_PARSED = "case regexp_extract(path, '([^.]*)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in PARSED_LANGUAGES.items()) + " end"
_KEYS = f"(select s.name, s.kind, s.path, count(*) as calls from {_LIVE} s join deps d on d.target_symbol = s.name and d.kind = 'calls' group by 1, 2, 3 order by 4 desc, 1, 2, 3 limit 10)"


def _terms(col: str) -> str:
    folded = f"translate(lower(coalesce({col}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+')"


def _bm25(phrases: list[list[str]], every: bool = True) -> str:
    """BM25 as one SELECT of (id, path, rank): terms as rows, one count per phrase."""
    cols = ["path", "header", "symbol"]
    toks = ", ".join(f"{_terms(c)} as t{k}" for k, c in enumerate(cols))
    tf = []
    for n, p in enumerate(phrases):
        per = [f"(select count(*) from range(1, len(t{k}) + 1) r(i) where " + " and ".join(f"t{k}[i + {j}] = '{w}'" for j, w in enumerate(p)) + ")" for k in range(3)]
        tf.append(" + ".join(per) + f" as f{n}")
    idf = [f"greatest(ln((docs - d{n} + 0.5) / (d{n} + 0.5)), 1e-6)" for n in range(len(phrases))]
    score = " + ".join(f"{idf[n]} * f{n} * 2.2 / (f{n} + 1.2 * (0.25 + 0.75 * len / avg_len))" for n in range(len(phrases)))
    where = (" and " if every else " or ").join(f"f{n} > 0" for n in range(len(phrases)))
    stats = ", ".join(f"count(*) filter (f{n} > 0) as d{n}" for n in range(len(phrases)))
    return f"""(with b as (select id, path, {toks} from (select distinct id, path, symbol, header from chunks)),
 c as (select id, path, len(t0) + len(t1) + len(t2) as len, {", ".join(tf)} from b),
 s as (select count(*) as docs, avg(len) as avg_len, {stats} from c)
 select id, path, -({score}) as rank from c, s where {where})"""


_SEARCH = _bm25([["node"], ["window"]])


def _edges(kind: str, a: str, b: str, out: str = "a.name as a_name, a.path as a_path, b.name as b_name, b.path as b_path") -> str:
    return f"""select {out} from deps d
 join {_LIVE} a on d.source_path = a.path and (d.source_symbol is null or d.source_symbol = a.name)
 join {_LIVE} b on d.target_symbol = b.name and (d.target_path is null or d.target_path = b.path)
 where d.kind = '{kind}' and {a} and {b}"""


_REFS = """e as (select id, source_path, target_path, target_symbol, seen_at, regexp_replace(target_symbol, '^.*(\\.|::|->)', '', 's') as nm from deps
 where (target_path is not null and target_path not in (select name from externals where kind = 'package'))
    or (target_path is null and target_symbol not in (select name from externals where kind = 'builtin'))),
fs as (select path, changed_at, arg_max(status, change_id) as status from file_changes where status <> 'hash-mismatch' group by 1, 2),
rs as (select distinct split_part(path, '/', 1) as repo, name, seen_at, gone_at from symbols),
found as (select 'files' as ref_table, e.id as dep_id, e.seen_at from e asof left join fs on e.target_path = fs.path and e.seen_at >= fs.changed_at
  where e.target_path is not null and (fs.status is null or fs.status = 'deleted')
 union select 'symbols', id, seen_at from e where target_path is not null and target_symbol <> '*'
  and not exists (select 1 from symbols s where s.path = e.target_path and s.name = e.nm and s.seen_at <= e.seen_at and (s.gone_at is null or s.gone_at > e.seen_at))
 union select 'symbols', id, seen_at from e where target_path is null
  and not exists (select 1 from rs s where s.repo = split_part(e.source_path, '/', 1) and s.name = e.nm and s.seen_at <= e.seen_at and (s.gone_at is null or s.gone_at > e.seen_at)))"""
_LINES = "case when source = '' then [''] when source like '%' || chr(10) then l[1:len(l) - 1] else l end"

SQL: dict[str, str] = {
    "find_symbols_like": f"select id, name, kind, path, line_start from {_LIVE} where regexp_matches(name, '(?i)t.ken') and kind = 'method'",
    "callers": "select id, source_path, source_symbol, target_symbol from deps where target_symbol = 'trace_span' and kind = 'calls'",
    "callees": "select id, source_path, source_symbol, target_symbol from deps where source_symbol = 'run' and kind = 'calls'",
    "imports_per_file": "select source_path, count(*) as n_imports, count(distinct target_path) as n_targets from deps where kind = 'imports' group by 1",
    "imports_of_path": "select id, target_path, target_symbol from deps where kind = 'imports' and source_path = 'corelane/pkg/tepifa/telemetry.py'",
    "importers": "select id, source_path, target_symbol from deps where target_path = 'stavework' and kind = 'imports'",
    "chunk_for_symbol": "select distinct id, path, kind, line_start, line_end from chunks where id = (select min(id) from chunks where symbol = 'reset')",
    "suggestions": f"select name from (select name, min(struct_pack(a := path, b := line_start, c := id)) as f from {_LIVE} where regexp_matches(name, '(?i)lease') group by 1) order by f, name limit 5",
    "pattern_nodes_contains": f"select id, name, path from {_LIVE} where kind = 'class' and regexp_matches(name, '(?i)buffer')",
    "pattern_nodes_line_number": f"select id, name, path from {_LIVE} where kind = 'function' and line_start = 5",
    "pattern_edges_calls": _edges("calls", "a.kind = 'function'", "b.kind = 'function'"),
    "pattern_edges_called_by": _edges("calls", "a.kind = 'method'", "b.kind = 'class' and regexp_matches(b.name, '(?i)pool')"),
    "pattern_edges_imports": _edges("imports", "a.kind = 'class'", "b.kind = 'function' and regexp_matches(b.path, '(?i)core')"),
    "pattern_rows_json": f"select to_json(struct_pack(a := struct_pack(name := name, path := path, parent := parent)))::varchar as row from {_LIVE} where kind = 'struct'",
    "key_symbols_top10": f"select * from {_KEYS}",
    "dead_code": f"select id, name, kind, path, line_start from {_LIVE} s where kind in ('function', 'method') and name not in ('main', 'new', 'default') and not regexp_matches(path, '(?i)test') and not exists (select 1 from deps d where d.kind = 'calls' and d.target_symbol = s.name)",
    "entry_points": f"select name || ' (' || kind || ') in ' || path as label from {_LIVE} where name = 'run' or regexp_matches(name, '(?i)init|entry|start')",
    "dead_code_count": f"select count(*) as dead from {_LIVE} s where kind in ('function', 'method') and name not in ('main', 'new', 'default') and not regexp_matches(path, '(?i)test') and not exists (select 1 from deps d where d.kind = 'calls' and d.target_symbol = s.name)",
    "pattern_returned": _edges("calls", "a.kind = 'method'", "b.kind = 'class'", "a.name as a_name, b.path as b_path, b.line_start as b_line_start"),
    "graph_nodes": f"select path || '::' || name as node_id, name, kind, path from {_LIVE}",
    "graph_edges": "select source_symbol as source, target_symbol as target, kind from deps where source_symbol is not null",
    "edges_between_names": f"select source_symbol as source, target_symbol as target, kind from deps where source_symbol in (select name from {_LIVE}) and target_symbol in (select name from {_LIVE})",
    "index_stats": "select (select count(*) from files) as files, (select max(indexed_at) from files) as last_indexed, (select count(*) from chunks) as chunks",
    "language_histogram": f"select {_LANG} as language, count(*) as files from {_FILES} group by 1",
    "top_directories": f"select {_DIR} as directory, count(*) as files from {_FILES} group by 1 order by 2 desc, 1 limit 10",
    "header_previews": """select path, string_agg(t, chr(10) order by n) as preview from (select path, n, case when symbol is null then h else '[' || symbol || '] ' || h end as t
 from (select *, split_part(coalesce(header, ''), chr(10), 1) as h, row_number() over (partition by path order by line_start nulls first, id) as n from (select distinct id, path, symbol, line_start, header from chunks)) where n <= 5) group by path""",
    "architecture_totals": f"""select (select count(*) from {_FILES}) as total_files, (select count(*) from {_LIVE}) as total_symbols,
 (select count(*) from {_LIVE} where name = 'main' or regexp_matches(name, '(?i)entry|start')) as entry_points, (select count(distinct {_LANG})::int from {_FILES}) as n_languages,
 (select name from {_KEYS} order by calls desc, name, kind, path limit 1) as top_symbol, (select {_DIR} from {_FILES} group by 1 order by count(*) desc, 1 limit 1) as top_directory""",
    "current_file_rows": f"select * from {_FILES}",
    "parsed_languages": f"select {_PARSED} as language, count(distinct path) as n_paths from files group by 1",
    "indexable_paths": r"""select distinct path from files where not list_has_any(string_split(path, '/'), ['.git', '.hg', '.svn', 'node_modules', '.venv', 'venv', 'env', '__pycache__', '.mypy_cache', '.pytest_cache', '.ruff_cache', 'dist', 'build', 'target', '.next', '.nuxt', 'out', 'vendor', 'evals'])
 and not regexp_matches(path, '\.(lock|map|png|jpg|jpeg|gif|ico|svg|pdf|zip|tar|gz|bin|so|dylib|dll|exe|o|a|class|pyc|pyo|db|sqlite|sqlite3)$') and not regexp_matches(path, '\.min\.(js|css)$')
 and not regexp_matches(path, '(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|uv\.lock|Cargo\.lock|\.DS_Store)$')""",
    "bm25_all_words": f"select id, path, round(rank, 6) as score from {_SEARCH}",
    "bm25_any_word": f"select id, round(rank, 6) as score from {_bm25([['lease'], ['quota']], False)}",
    "bm25_phrase": f"select id, round(rank, 6) as score from {_bm25([['trace', 'span'], ['py']])}",
    "bm25_kept_index": f"select id, path, round(rank, 6) as score from {_bm25([['to', 'text'], ['ledger']], False)}",
    "index_terms": f"""with t as (select id, unnest({_terms('path')} || {_terms('header')} || {_terms('symbol')}) as term from (select distinct id, path, symbol, header from chunks))
 select term, count(distinct id) as chunks, count(*) as occurrences from t group by 1""",
    "bm25_best_per_file": f"""with h as (select id, path, round(rank, 6) as score from {_SEARCH} order by 3, 1 limit 40)
 select id, path, score from (select *, row_number() over (partition by path order by score, id) as n from h) where n = 1 order by score, id limit 10""",
    "minmax_scores": f"with h as (select id, -rank as s from {_SEARCH}) select id, round((s - (select min(s) from h)) / greatest((select max(s) - min(s) from h), 1e-6), 5) as score from h",
    "nearest_vectors": """select query_id, vec_id, round(s, 4) as score, n::int as n from (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as s,
 row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 12) desc, v.vec_id) as n from embeddings q, embeddings v where q.vec_id % 100 = 0) where n <= 10""",
    "chunks_with_vectors": "select distinct c.id, c.path, c.symbol, len(embedding)::int as dim from chunks c join embeddings e on e.vec_id = c.id",
    "cosine_to_label_centre": """with x as (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as k from embeddings), m as (select label, k, avg(x::double) as x from x group by 1, 2),
 c as (select label, list(x order by k) as centre from m group by 1) select vec_id, e.label, round(list_cosine_similarity(embedding::double[], centre), 4) as score from embeddings e join c using (label)""",
    "vector_codec": "select vec_id, (4 * len(embedding))::int as n_bytes, true as same from embeddings",
    "fused_search": f"""with q as (select embedding as qv from embeddings order by vec_id limit 1), c as (select distinct id, path, symbol, source from chunks),
 t as (select id, -rank as s from {_bm25([["lease"], ["window"], ["reset"]])} order by rank, id limit 50),
 v as (select vec_id as id, list_cosine_similarity(embedding::double[], qv::double[]) as s from embeddings, q where vec_id in (select id from c)),
 u as (select id, 0.30 * (s - (select min(s) from t)) / greatest((select max(s) - min(s) from t), 1e-6) as s from t
  union all select id, 0.55 * (s - (select min(s) from v)) / greatest((select max(s) - min(s) from v), 1e-6) from v
  union all select id, 0.15 from c where symbol in ('lease', 'window', 'reset')),
 f as (select id, sum(s) as s from u group by 1 order by 2 desc, 1 limit 20)
 select f.id, path, strlen(source) > 2400 as truncated, round(s, 4) as score from f join c using (id)""",
    "exact_symbol_hits": "select distinct id, symbol from chunks where symbol in ('reset', 'run', 'Parse')",
    "retrieval_metrics": f"""with s as (select id, path, name from {_LIVE}), e as (select * from s where id % 100 = 0),
 h as (select e.id as q, s.path, s.name, row_number() over (partition by e.id order by s.path, s.id) as rank from e join s using (name)),
 f as (select e.id, min(rank) as first from e left join h on h.q = e.id and h.path = e.path and h.name = e.name and rank <= 10 group by 1)
 select round(100 * avg((coalesce(first, 99) <= 1)::int::double), 4) as hit_at_1, round(100 * avg((coalesce(first, 99) <= 3)::int::double), 4) as hit_at_3, round(100 * avg((coalesce(first, 99) <= 5)::int::double), 4) as hit_at_5,
 round(avg(coalesce(1.0::double / first, 0)), 4) as mrr, count(*) filter (first is null) as misses from f""",
    "chunk_slices": f"""with w as (select path, source, string_split(replace(source, chr(13) || chr(10), chr(10)), chr(10)) as l from {_WHOLE} where source is not null), t as (select path, source, {_LINES} as l, greatest(len({_LINES}), 1) as n from w),
 k as (select * from {_LIVE} where kind in ('function', 'method', 'struct', 'class', 'trait', 'interface', 'enum', 'type')),
 j as (select t.*, k.name, k.kind, k.path is null as whole, least(greatest(line_start, 1), n) as a, line_end from t left join k on k.path = t.path),
 b as (select *, case when whole then n else least(greatest(line_end, a), greatest(n, a)) end as z from j)
 select path, name as symbol, coalesce(kind, 'file') as kind, (case when whole then 1 else a end)::int as line_start, z::int as line_end,
 sha256(case when whole then source else array_to_string(l[a:z], chr(10)) end) as body_sha256 from b""",
    "body_hashes": "select id, sha256(source) as body_hash from chunks",
    "file_plan": f"select coalesce(a.path, b.path) as path, case when a.path is null then 'delete' when b.sha256 <> '' and b.sha256 = a.sha256 then 'skip' else 'index' end as action from {_WHOLE} a full join {_FILES} b on a.path = b.path",
    "file_plan_counters": f"""with p as (select a.path as a, b.sha256 <> '' and b.sha256 = a.sha256 as same from {_WHOLE} a full join {_FILES} b on a.path = b.path),
 o as (select path, symbol, body_sha256 from chunks where header <> '' and body_sha256 <> '' group by 1, 2, 3),
 r as (select o.path is not null as reused from chunks c left join o on o.path is not distinct from c.path and o.symbol is not distinct from c.symbol and o.body_sha256 is not distinct from c.body_sha256)
 select count(*) filter (a is not null) as found, count(*) filter (a is not null and same) as unchanged, count(*) filter (a is not null and same is not true) as to_index, count(*) filter (a is null) as deleted,
 (select count(distinct path) from chunks where source is null) as errors, (select count(*) from r) as chunks, (select count(*) from r where reused) as reused, (select count(*) from r where not reused) as failed from p""",
    "chunk_reuse": """with o as (select path, symbol, body_sha256, arg_max(header, id) as header from chunks where kind <> 'method' and body_sha256 <> '' group by 1, 2, 3)
 select c.kind, count(*) as pending, count(o.header) as reused from chunks c left join o on o.path is not distinct from c.path and o.symbol is not distinct from c.symbol and o.body_sha256 is not distinct from c.body_sha256 group by 1""",
    "replaced_paths": f"""with n as {_NEWEST} select id, c.path, kind from chunks c where c.path not in (select path from n where status = 'deleted') and c.path not in (select path from n where status = 'modified')
 union all select id, c.path, 'new' from chunks c where c.path in (select path from n where status = 'modified')""",
    "newest_changes": f"select path, status from {_NEWEST}",
    "staleness": f"""with n as (select path, status from {_NEWEST} where status = 'modified') select path, status from n
 union all select f.path, case when w.path is null then 'deleted' else 'hash-mismatch' end from {_FILES} f left join {_WHOLE} w using (path)
 where f.path not in (select path from n) and (w.path is null or w.sha256 <> coalesce(f.sha256, ''))""",
    "status_lines": "select case status when 'hash-mismatch' then 'modified' else status end as status, count(*) as n, count(distinct path) as n_paths from file_changes group by 1",
    "glob_queries": r"""select distinct path, nullif(trim(regexp_replace(replace('**/' || regexp_replace(path, '[^/]+$', '*') || regexp_extract(path, '(\.[a-z]+)$', 1), '**', ' '), '[*/.]', ' ', 'g')), '') as words from files""",
    "watched_changes": "select distinct change_id, path, status from file_changes where not list_has_any(string_split(path, '/'), ['build', 'dist', 'target', 'vendor', 'node_modules', 'tests'])",
    "p3_found": f"with {_REFS} select distinct ref_table, dep_id from found",
    "p3_report": f"with {_REFS} select ref_table, strftime(seen_at::timestamp, '%Y-%m') as month, count(*) as orphans from found group by 1, 2",
    "p3_current_orphans": f"""with {_REFS}, r as (select 'files' as ref_table, target_path as ref_key, count(*) as refs from e where target_path is not null group by 1, 2
  union all select 'symbols', 'p|' || target_path || '|' || nm, count(*) from e where target_path is not null and target_symbol <> '*' group by 1, 2
  union all select 'symbols', 'r|' || split_part(source_path, '/', 1) || '|' || nm, count(*) from e where target_path is null group by 1, 2),
 x as (select 'files' as ref_table, path as ref_key from fs group by 1, 2 having arg_max(status, changed_at) <> 'deleted' union select 'symbols', 'p|' || path || '|' || name from symbols where gone_at is null
  union select 'symbols', 'r|' || split_part(path, '/', 1) || '|' || name from symbols where gone_at is null) select r.* from r anti join x using (ref_table, ref_key)""",
    "like_matches": "select split_part(source_path, '/', 1) as repo, count(*) as n from deps where regexp_matches(target_symbol, '(?i)trace.s.*n') group by 1",
    "meta_after_put": "select key, value from meta where key <> 'schema_version' union all select 'schema_version', '4' union all select 'files.' || split_part(path, '/', 1), count(*)::varchar from files group by 1",
    "cached_results": f"""with h as (select id, path, rank as r from {_SEARCH} order by rank, id limit 10) select (row_number() over (order by r, id) - 1)::int as rank, id, path, round(round(-r, 3)::float::double, 2) as score from h""",
    "capped_sources": """select id, (case when strlen(source) <= 240 then strlen(source) else list_max(list_filter(list_transform(range(0, 241), lambda n: strlen(left(source, n))), lambda b: b <= 240)) end)::int as n_bytes,
 strlen(source) > 240 as truncated from chunks""",
    "debounced_events": """with recursive e as (select event_id, event_type, ts from events where event_type is not null and ts is not null),
 a as (select event_type, ts, arg_min(event_id, event_id) as event_id from e group by 1, 2),
 n as materialized (select a.event_id, b.event_id as later from a asof join a b on a.event_type = b.event_type and a.ts <= b.ts - interval 300 second),
 r as (select arg_min(event_id, ts) as event_id from a group by event_type union all select n.later from r join n using (event_id))
 select event_id, event_type from e where event_id in (select event_id from r)""",
    "hit_json": """select distinct id, '{"path":' || to_json(path)::varchar || ',"symbol":' || coalesce(to_json(symbol)::varchar, 'null') || case when kind = 'struct' and parent is not null then ',"source":' || to_json(parent)::varchar else '' end || '}' as hit from chunks""",
    "hit_lines": "select distinct id, rtrim(path || ':' || line_start || '-' || line_end || ' ' || coalesce(symbol, '')) as line from chunks where kind <> 'file'",
    "tool_queries": f"""select id, case kind when 'class' then '**/' || path when 'method' then nullif(trim(regexp_replace(replace('**/' || path, '**', ' '), '[*/.]', ' ', 'g')), '') end as search from {_LIVE}""",
    "change_rates_daily": "select strftime(changed_at::timestamp, '%Y-%m-%d') as day, split_part(path, '/', 1) as repo, status, count(*) as n from file_changes where path is not null and changed_at is not null group by 1, 2, 3",
}
