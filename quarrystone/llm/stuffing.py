"""Keyword-stuffed and link-list pages (problem 8)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread

# Function words of the corpus's languages.
_FUNCTION = {
    "en": "the a an and or of to in is are was were be been it its that this these those for from with by on at as if then so not no but when while which who what where how why you your we our they their he she i my me us there has have had do does did can could will would should may than before after until because both each every some any most more less one here into out up over because only even",
    "de": "der die das ein eine einen einem einer und oder nicht ist sind war wird weil wenn dass im in am auf mit von zu zum zur den dem des sich wir ihr sie er es bitte solange danach ohne bis etwa erneut hat haben bleibt nach unter jede jeden",
    "es": "el la los las un una unos unas y o de del al en con por para que se no sin cuando porque como más mientras siga vuelve cada tras lo su sus es son era ha hay",
    "fr": "le la les un une des du de et ou en dans sur avec par pour que qui ne pas car quand est sont nous vous il elle on ce cette ces son sa ses plus chaque sous trop sans après avant tant à l s d n qu",
}
FUNCTION_WORDS = frozenset(w for words in _FUNCTION.values() for w in words.split())
BLOCK_WORDS = 14  # short lines and sentences are joined until a block has as many words
URL_WORDS = 4  # words that an address counts for
FUNCTION_SHARE = 0.3  # of the pages of a language hold a word that counts as one of its function words
PRIOR_PAGES = 20  # pages of its own after which a language's limits weigh as much as those of all pages
MIN_WORDS = 12  # pages with fewer stuffed words are short notes

_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_END = re.compile(r"[^\W\d_]+|\x00")
_ADDRESS = r"(?:https?://|www\.)[^\s\]<>()\"']+"
_IMAGE = re.compile(r"\[?!\[[^\]\n]*\]\([^)\n]*\)(?:\]\([^)\n]*\))?")
_PAGE_ANCHOR = re.compile(r"\[([^\]\n]*)\]\(#[^)\n]*\)")
_LINK = re.compile(
    rf"(?=[<\[hHwW])(?:<a\s[^>]*>(?P<a>.*?)</a>|\[url=[^\]]*\](?P<b>.*?)\[/url\]|\[url\](?P<u>.*?)\[/url\]|\[(?P<c>[^\]\n]*)\]\((?:{_ADDRESS})[^)\n]*\)|(?P<d>{_ADDRESS}))", re.S | re.I
)
_TAG = re.compile(r"(?<!\S)#[^\W\d]\w*")
_CODE = re.compile(r"[(){}=_\[\]]")
_SEPARATOR = re.compile(r"[|;,/*•·~>-]")
_LINE_BREAK, _SENTENCE_END = re.compile(r"<br\s*/?>"), re.compile(r"([.!?])[^\S\n]\s*")
_MARKED = re.compile(r"\x01\d+\x02")
_BREAK = re.compile(r"<br\s*/?>", re.I)
_LONE = re.compile(r" [^\W\d_] [^\W\d_] [^\W\d_]")
_CLOCK, _DATE, _LEVELS = re.compile(r":\d\d"), re.compile(r"-\d\d-"), ("WARN", "INFO", "ERROR", "DEBUG", "Traceback")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){4,}[^\W\d_](?!\w)")
_LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d|\d\d:\d\d)|\b(?:WARN|INFO|ERROR|DEBUG|Traceback)\b")
BLOCK_FIELDS = ("words", "function", "repeated", "linked", "tagged", "code", "separators")
_BLOCKS = "array<struct<words:int,function:double,repeated:double,linked:double,tagged:double,code:double,separators:double>>"
_SCHEMA = f"doc_id bigint, lang string, words int, function double, top_word double, top_bigram double, same_lines double, blocks {_BLOCKS}"


def _segments(text: str) -> list[tuple[str, int, int, int, int]]:
    """(plain text, link words, tags, code characters, links) of the lines and sentences of a text."""
    if "](#" in text or "![" in text:
        text = _PAGE_ANCHOR.sub(r"\1", _IMAGE.sub(" ", text))
    if _LONE.search(text):
        text = _SPACED.sub(lambda m: "spacedletters " * (1 + len(m.group()) // 8), text)  # l i k e  t h i s
    out, links = [], {}

    def hide(m: re.Match) -> str:
        shown = next((m[g] for g in "abc" if m[g] is not None), "")
        key = f"\x01{len(links)}\x02"
        links[key] = (len(_WORD.findall(shown)) + URL_WORDS, shown)
        return f" {key} "

    hidden = _LINK.sub(hide, text)
    tags, log, code_marks = "#" in hidden, bool(_CLOCK.search(hidden) or _DATE.search(hidden) or any(x in hidden for x in _LEVELS)), bool(_CODE.search(hidden))
    if "<br" in hidden:
        hidden = _LINE_BREAK.sub("\n", hidden)
    for part in _SENTENCE_END.sub(r"\1\n", hidden).split("\n"):
        if part.strip():
            marks = _MARKED.findall(part) if links and "\x01" in part else ()
            linked = sum(links[m][0] for m in marks)
            plain = _MARKED.sub(lambda m: links[m.group()][1], part) if marks else part
            bare = _MARKED.sub(" ", part) if marks else part
            code = 0
            if (code_marks or log) and not (marks and not _WORD.search(bare)):
                code = len(_CODE.findall(bare)) + (8 if log and _LOG.search(bare) else 0)
            out.append((plain, linked, len(_TAG.findall(part)) if tags else 0, code, len(marks)))
    return out


def features(texts: list[str], function_words: list[frozenset[str]] | None = None) -> list[dict]:
    """Shares that tell stuffed text from sentences, of each text and of its blocks.

    ``function_words`` has one set per text. Every text is tokenised once; words are numbers from there
    on, and all counts of the texts are made together.
    """
    told = function_words or [FUNCTION_WORDS] * len(texts)
    names: dict[str, int] = {"\x00": 0}
    segments, numbers, page_of, block_of, plain, tails = [], [], [], [], [], []
    for k, text in enumerate(texts):
        own = _segments(text)
        ids = [names.setdefault(w, len(names)) for w in _WORD_OR_END.findall("\x00".join([*(s[0] for s in own), ""]).lower())]
        numbers += ids
        size, first = 0, len(plain)
        for s, n in zip(own, _held(ids), strict=True):  # lines and sentences are joined until a block is large enough
            if len(plain) == first or size >= BLOCK_WORDS:
                plain.append("")
                size = 0
            plain[-1] += s[0]
            size += n + URL_WORDS * s[4]
            segments.append(s[1:])
            page_of.append(k)
            block_of.append(len(plain) - 1)
        tails.append(len(plain))
    every, vocabulary = np.array(numbers, np.int64), len(names)
    ends = every == 0
    t, seg = every[~ends], np.cumsum(ends)[~ends]
    page, block = np.array(page_of, np.int64)[seg], np.array(block_of, np.int64)[seg]
    sets = {id(f): f for f in told}
    flags = {k: np.array([w not in f for w in names]) for k, f in sets.items()}
    is_content = np.stack([flags[k] for k in sets])[np.array([list(sets).index(id(f)) for f in told], np.int64)[page], t] if len(t) else np.zeros(0, bool)
    n_pages, n_blocks = len(texts), len(plain)
    total = np.maximum(1, np.bincount(page, minlength=n_pages))
    key = page * vocabulary + t
    found, back, n = np.unique(key, return_inverse=True, return_counts=True)
    count = np.where(is_content, n[back], 0)
    top_word = _greatest(page, count, n_pages)
    covered = (count >= 4) & (count / total[page] >= 0.02)
    inner, top_pair = np.zeros(n_blocks), np.zeros(n_pages, np.int64)
    if len(t) > 2:
        pairs = key[:-1] * vocabulary + t[1:]
        both = (seg[:-1] == seg[1:]) & is_content[:-1] & is_content[1:]
        found, n = np.unique(pairs[both], return_counts=True)
        top_pair = _greatest(found // vocabulary**2, n, n_pages)
        phrases = (block[:-1] == block[1:]) & np.isin(pairs, found[n >= 3])
        bridge = is_content[:-2] & ~is_content[1:-1] & is_content[2:]
        triples = pairs[:-1] * vocabulary + t[2:]
        found, n = np.unique(triples[bridge & (seg[:-2] == seg[2:])], return_counts=True)
        found = found[(n >= 3) & (3 * n / total[found // vocabulary**3] >= 0.03)]
        inside = bridge & (block[:-2] == block[2:]) & np.isin(triples, found)
        inner = np.bincount(block[:-2][inside], minlength=n_blocks)  # the function word of a repeated keyword belongs to it
        for shift in range(3):
            covered[shift : len(t) - 2 + shift] |= inside
        for shift in range(2):
            covered[shift : len(t) - 1 + shift] |= phrases
    words = np.bincount(block, minlength=n_blocks)
    functional = np.bincount(block, weights=~is_content, minlength=n_blocks)
    functional_all = np.bincount(page, weights=~is_content, minlength=n_pages)
    less = functional - inner
    functional = np.where(less <= 0.12 * words, less, functional)  # else these are sentences that say the same again
    repeated = np.bincount(block, weights=covered, minlength=n_blocks)
    sums = np.zeros((n_blocks, 4), np.int64)
    np.add.at(sums, np.array(block_of, np.int64), np.array(segments, np.int64).reshape(-1, 4))
    least = np.maximum(1, words)
    size = words + URL_WORDS * sums[:, 3]
    shares = zip(
        size.tolist(), (functional / least).tolist(), (repeated / least).tolist(), np.minimum(1.0, sums[:, 0] / np.maximum(1, size)).tolist(), (sums[:, 1] / least).tolist(),
        [c / max(1, len(x)) for c, x in zip(sums[:, 2].tolist(), plain, strict=True)], [len(_SEPARATOR.findall(x)) / m for x, m in zip(plain, least.tolist(), strict=True)], strict=True,
    )
    blocks = [dict(zip(BLOCK_FIELDS, x, strict=True)) for x in shares]
    out, at = [], 0
    for k, text in enumerate(texts):
        lines = [ln for x in (_BREAK.sub("\n", text) if "<" in text else text).split("\n") if (ln := x.strip())]
        own, at = blocks[at : tails[k]], tails[k]
        out.append({
            "words": sum(x["words"] for x in own), "function": float(functional_all[k] / total[k]), "top_word": float(top_word[k] / total[k]), "top_bigram": float(2 * top_pair[k] / total[k]),
            "same_lines": 1 - len(set(lines)) / max(1, len(lines)), "blocks": own,
        })
    return out


def _held(ids: list[int]) -> Iterator[int]:
    """Lengths of the runs of a list that zeros end."""
    at = 0
    while at < len(ids):
        end = ids.index(0, at)
        yield end - at
        at = end + 1


def _greatest(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, place, value)
    return out


def _pages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the documents with an id and a text that is not blank."""
    lang = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})(?![a-z])", 1), F.lit("")), F.lit("und"))
    return documents.where("doc_id is not null and text is not null and trim(text) != ''").select("doc_id", lang.alias("lang"), "text")


def function_words(documents: DataFrame) -> dict[str, frozenset[str]]:
    """The words that at least ``FUNCTION_SHARE`` of a language's pages hold, for the languages without a fixed list.

    All pages of such languages are counted, words by partial sums. At most 1 / FUNCTION_SHARE times
    the mean number of distinct words of a page per language come to the driver, for at most 26^2 + 26^3 codes.
    """
    pages = _pages(documents).where(~F.col("lang").isin(*_FUNCTION, "und"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter((g, w) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in set(_WORD.findall(t.lower())) | {""})
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

    counts = checkpointed(pages.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sizes = counts.where("word = ''").select("lang", F.col("n").alias("pages"))  # the empty word stands in every page
    often = counts.where("word != '' and n > 1").join(F.broadcast(sizes), "lang").where(F.col("n") >= FUNCTION_SHARE * F.col("pages"))
    out: dict[str, set[str]] = {}
    for r in often.select("lang", "word").collect():
        out.setdefault(r["lang"], set()).add(r["word"])
    return {g: frozenset(w) | FUNCTION_WORDS for g, w in out.items()}


def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows in parts of about a million characters, which bounds the number of words in one numbering."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[2])
        if size >= 1_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def page_features(documents: DataFrame) -> DataFrame:
    """Features of documents (doc_id, text, lang); null ids and null or blank texts have none.

    ``lang`` becomes the two or three letters it begins with (en-US is en), else ``und``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(function_words(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("words", pa.int32()), *[(n, pa.float64()) for n in BLOCK_FIELDS[1:]]])
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), *[(n, pa.float64()) for n in ("function", "top_word", "top_bigram", "same_lines")], ("blocks", pa.list_(block))])
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for part in _parts(rows):
                told = features([r[2] for r in part], [shared.value.get(r[1], FUNCTION_WORDS) for r in part])
                yield pa.RecordBatch.from_pylist([{"doc_id": r[0], "lang": r[1]} | f for r, f in zip(part, told, strict=True)], schema=schema)

    return spread(_pages(documents)).mapInArrow(run, _SCHEMA)


def calibrated(pages: DataFrame) -> DataFrame:
    """(lang, low_function, high_word, high_bigram): limits of each language from all of its pages.

    Sentences of a language hold about the same share of function words; below half of the median is
    too few. A share of one word or of one pair of words is high above twice the upper quartile. The
    quantiles of a language are drawn towards those of all pages, as if it had ``PRIOR_PAGES`` more
    pages of the usual kind, so a language of few pages has sound limits too.
    """
    wanted = lambda: [F.percentile_approx(c, q, 1000).alias(n) for c, q, n in (("function", 0.5, "f"), ("top_word", 0.75, "w"), ("top_bigram", 0.75, "b"))]
    stats = pages.groupBy("lang").agg(*wanted(), F.count("*").alias("n"))
    whole = pages.agg(*wanted()).select(*[F.col(c).alias(f"all_{c}") for c in "fwb"])
    drawn = lambda c: (F.col("n") * F.col(c) + PRIOR_PAGES * F.col(f"all_{c}")) / (F.col("n") + PRIOR_PAGES)
    limits = stats.join(F.broadcast(whole)).select("lang", (drawn("f") * 0.5).alias("f"), (drawn("w") * 2).alias("w"), (drawn("b") * 2).alias("b"))  # one row
    return limits.select("lang", F.greatest("f", F.lit(0.12)).alias("low_function"), F.least("w", F.lit(0.3)).alias("high_word"), F.least("b", F.lit(0.3)).alias("high_bigram"))


def _stuffed(block: Column, low: Column, whole: Column) -> Column:
    """Whether a block is no sentence (few function words, no code) and links, tags or repetition make it up."""
    linked = (block["linked"] >= 0.5) | ((block["linked"] >= 0.3) & (block["separators"] > 0.1))
    listed = (block["repeated"] >= 0.6) | ((block["repeated"] >= 0.35) & (whole | (block["separators"] >= 0.25)))
    return (block["linked"] >= 0.8) | (block["function"] < low) & ((block["tagged"] >= 0.4) | linked | (listed & (block["code"] < 0.02)))


def stuffed_share(pages: DataFrame) -> DataFrame:
    """``pages`` with the number and share of words in stuffed blocks.

    The limits are broadcast, as most pages may be of one language: a code is two or three letters, so
    there are at most 26^2 + 26^3 + 1 rows of four numbers, under 1 MB.
    """
    joined = pages.join(F.broadcast(calibrated(pages)), "lang")
    whole = (F.col("top_word") > F.col("high_word")) | (F.col("top_bigram") > F.col("high_bigram")) | (F.col("same_lines") > 0.3)
    bad = F.filter("blocks", lambda b: _stuffed(b, F.col("low_function"), whole))
    count = F.aggregate(bad, F.lit(0), lambda s, b: s + b["words"])
    return joined.withColumn("stuffed_words", count).withColumn("stuffed_share", count / F.greatest("words", F.lit(1)))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, words, stuffed_words, stuffed_share) of pages more than half of whose words are stuffed.

    Function words, repetition and separators are judged in blocks of lines or sentences, so
    sentences around a list do not hide it and a keyword in front of a sentence does not condemn it.
    The limit of function words, and of word and pair shares, comes from all pages of the language.
    Pages with fewer than ``MIN_WORDS`` stuffed words are short notes. Copies are judged alike. An
    empty table gives no rows.
    """
    judged = stuffed_share(checkpointed(page_features(documents)))
    return judged.where((F.col("stuffed_share") > 0.5) & (F.col("stuffed_words") >= MIN_WORDS)).select("doc_id", "lang", "words", "stuffed_words", "stuffed_share")
