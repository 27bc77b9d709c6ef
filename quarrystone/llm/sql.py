"""DuckDB SQL of the registered queries of this package."""

# Python's \\w is a letter, a number of any kind or _, its \\s the white space of Unicode
_WORD, _OTHER = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_SIZES = f"(select doc_id, max(len(regexp_extract_all(text, '{_WORD}|{_OTHER}'))) as n from documents where doc_id is not null and text is not null group by 1)"

SQL: dict[str, str] = {
    "p2_found": "select distinct id as chunk_id from chunks where strlen(source) > 6000",
    "p2_reassembled": "select distinct id as chunk_id, strlen(source)::int as n_bytes, sha256(source) as sha256, 0 as excess from chunks where strlen(source) > 6000",
    "p6_items": f"select doc_id, n as n_tokens, ceil(n / 2048)::bigint as parts from {_SIZES} where n > 0",
    "p6_overfull": f"select sum(n)::bigint as tokens, 0 as overfull from {_SIZES}",
}
