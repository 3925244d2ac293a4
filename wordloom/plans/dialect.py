"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from wordloom.functions.text import INDEX_STOPWORDS

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters and digits, with the vowel signs of Devanagari, which are letters too but no category of their own in RE2.
ALNUM = r"\p{L}\p{N}\x{0900}-\x{0903}\x{093a}\x{093b}\x{093e}-\x{094c}\x{0955}-\x{0957}\x{0962}\x{0963}"


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def index_tokens(text: str) -> str:
    tidy = (
        f"translate(regexp_replace(w, '[^{ALNUM}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    return (
        f"list_filter([{tidy} for w in regexp_split_to_array(coalesce({text}, ''), '{WS}+')], "
        f"lambda t: octet_length(encode(t)) > 2 AND t NOT IN ({quoted(INDEX_STOPWORDS)}))"
    )


def normal_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{WS}+'), lambda w: w <> '')"


def fingerprint_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^{ALNUM}]+'), lambda w: w <> '')"


def trim(text: str) -> str:
    return rf"regexp_replace({text}, '^[\x1c-\x1f]*{WS}+|{WS}+$', '', 'g')"


def led(nodes: str, near: str) -> str:
    """CTEs ``o, e, led(rn, anchor)`` of records that come one by one, each joining the first cluster whose anchor is near.

    ``nodes`` is SQL for ``node, since`` and ``near`` for ``a, b``, pairs of nodes. The recursion holds the anchors so far.
    """
    return f"""nodes AS ({nodes}), pairs AS ({near}),
o AS (SELECT node, row_number() OVER (ORDER BY since NULLS FIRST, node) AS rn FROM nodes),
e AS (SELECT y.rn, list(x.rn) AS near FROM (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) p JOIN o x ON x.node = p.a JOIN o y ON y.node = p.b WHERE x.rn < y.rn GROUP BY y.rn),
steps AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS anchors, 0::BIGINT AS anchor UNION ALL
  SELECT rn, CASE WHEN hit IS NULL THEN list_append(anchors, rn) ELSE anchors END, coalesce(hit, rn) FROM (
    SELECT o.rn, steps.anchors, list_filter(steps.anchors, lambda q: list_contains(coalesce(e.near, []), q))[1] AS hit
    FROM steps JOIN o ON o.rn = steps.rn + 1 LEFT JOIN e ON e.rn = o.rn)),
led AS (SELECT o.node, h.node AS anchor FROM steps JOIN o ON o.rn = steps.rn JOIN o h ON h.rn = steps.anchor)"""
