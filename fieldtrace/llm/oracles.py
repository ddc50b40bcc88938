"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import hashlib
import re

from fieldtrace.llm.licenses import EQUIVALENT_SPELLINGS, KNOWN_LICENSES, whole_texts

#: Words after "copyright" by which a line is a sentence of a licence, not a notice of a work.
_SENTENCE = "and or in of on to if is are as by for from under that which with within this these you your any all such must may shall not no notice notices holder holders owner owners owned law laws license licence licenses licences licensed interest interests right rights statement statements disclaimer disclaimers protection permission claim claims treaty treaties ownership status"
_STARTS = r"^[ \t]*(copyright|\(c\))"
#: What after the start makes a line no notice: another word, a stop, nothing, or a sentence.
_NO_NOTICE = rf"^[ \t]*(copyright(ed|able|s)\b|(copyright|\(c\))([.;)]|[ \t]*$|[ \t,]+({'|'.join(_SENTENCE.split())})\b))"
_SIGN = r"^[ \t]*©"
_MARKS = "“”‘’–—\xa0"


def _digest(text: str) -> str:
    """The digest of a known licence, word by word."""
    lines = [x for x in text.lower().split("\n") if not (re.search(_SIGN, x) or re.search(_STARTS, x) and not re.search(_NO_NOTICE, x))]
    same = dict(EQUIVALENT_SPELLINGS)
    words = re.sub(rf"[\x01-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f{_MARKS}]", " ", "\n".join(lines)).split()
    return hashlib.sha256(" ".join(same.get(w, w) for w in words).encode()).hexdigest()


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_scan() -> str:
    notice = f"regexp_matches(x, {_quoted(_SIGN)}) OR (regexp_matches(x, {_quoted(_STARTS)}) AND NOT regexp_matches(x, {_quoted(_NO_NOTICE)}))"

    def digest(x: str) -> str:
        cases = " ".join(f"WHEN {_quoted(written)} THEN {_quoted(same)}" for written, same in EQUIVALENT_SPELLINGS)
        words = f"string_split(regexp_replace({x}, '[\\x01-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F{_MARKS}]', ' ', 'g'), ' ')"
        return f"sha256(array_to_string([CASE x {cases} ELSE x END for x in {words} if x <> ''], ' '))"

    found: dict[str, str] = {}
    for name, text in sorted([*KNOWN_LICENSES, *whole_texts()]):
        found.setdefault(_digest(text), name)
    known = ", ".join(f"('{d}', {_quoted(i)})" for d, i in found.items())
    return f"""
WITH known(digest, license_id) AS (VALUES {known}),
plain AS (
  SELECT doc_id, [CASE WHEN {notice} THEN '' ELSE x END for x in string_split(lower(coalesce(text, '')), chr(10))] AS lines FROM documents
), texts AS (
  SELECT p.doc_id, min(k.license_id) AS text_license FROM plain p LEFT JOIN known k ON {digest("array_to_string(p.lines, chr(10))")} = k.digest GROUP BY 1
), units AS (
  SELECT DISTINCT doc_id, unnest(lines) AS line FROM plain
), lines AS (
  SELECT u.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
  FROM units u LEFT JOIN known k ON {digest('u.line')} = k.digest GROUP BY 1
)
SELECT t.doc_id, t.text_license, coalesce(l.ids, '') AS line_licenses FROM texts t JOIN lines l USING (doc_id)"""


def _collocations(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({fold}, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents
), listed AS (
  SELECT lang, [x for x in regexp_split_to_array(piece, '[ \\t]+') if x <> ''] AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM listed GROUP BY 1
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed WHERE len(w) > 0
), runs AS (
  SELECT lang, w[i : i + k - 1] AS words FROM spots, range(1, {longest} + 1) AS t(k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, words, count(*) AS f FROM runs GROUP BY 1, 2 HAVING count(*) >= {least}
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, p.f AS l, r.f AS r, t.n,
    CAST(1000 AS HUGEINT) * c.f * t.n // (CAST(p.f AS HUGEINT) * r.f) AS score
  FROM f c, range(1, {longest}) AS g(k), f p, f r, totals t
  WHERE k < len(c.words) AND p.lang = c.lang AND p.words = c.words[1 : k] AND r.lang = c.lang AND r.words = c.words[k + 1 : len(c.words)] AND t.lang = c.lang
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_runs AS (
  SELECT lang, words[i : i + m - 1] AS words, max(a) AS f
  FROM low, range(1, {longest}) AS x(i), range(2, {longest}) AS y(m) WHERE m < len(words) AND i + m - 1 <= len(words) GROUP BY 1, 2
), kept AS (
  SELECT low.*, array_to_string(low.words, ' ') AS phrase FROM low LEFT JOIN inner_runs i ON low.lang = i.lang AND low.words = i.words
  WHERE i.f IS NULL OR 100 * i.f < 100 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": _license_scan(), "op13_collocations": _collocations()}
