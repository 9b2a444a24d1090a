"""SQL of the check of whole texts: skip ranges, segmentation, identifier parts and places.

Made for DuckDB, whose expressions have neither look-around nor match positions: matches are put between two
marks, a text is cut at these, and running sums of lengths give the places. Segmentation writes Unicode's word
boundaries out as one expression for letters, marks, digits and the signs that join them.
"""

from __future__ import annotations

from .operators.ranges import DEFAULT_SKIP

#: A letter joined to the next by a sign between letters, digits by one between digits, or any sign of a word.
TOKEN = r"(?:[\p{L}\p{M}](?:[''’.:·]\p{L}\p{M}*)+|\p{Nd}(?:[.,;''’]\p{Nd})+|[\p{L}\p{M}\p{N}_])+"
HEX = 7  # the place of the pattern that looks ahead for a digit
_CUTS = r"([^\p{Lu}0-9_.:])(\p{Lu})", r"(\p{Lu})(\p{Lu}[a-z])", r"([^0-9_.:])([0-9])", r"([0-9])([^0-9_.:])"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def matches(name: str, table: str, key: str, pattern: str, having: str = "") -> str:
    """CTEs whose last, `name`, has (key, k, hit, gap, c, b): the hit's first character and byte from 0, and the text behind it.

    `name`_at also has what is before the first hit, as a gap of place 0.
    """
    return rf"""
{name}_cut AS (
  SELECT {key}, string_split(regexp_replace(text, '({pattern})', chr(2) || '\1' || chr(3), 'g'), chr(2)) AS p FROM {table}
), {name}_piece AS (
  SELECT {key}, unnest(range(len(p))) AS k, unnest(p) AS p FROM {name}_cut
), {name}_at AS (
  SELECT {key}, k, CASE WHEN k > 0 THEN string_split(p, chr(3))[1] END AS hit, CASE WHEN k > 0 THEN string_split(p, chr(3))[2] ELSE p END AS gap,
         sum(length(replace(p, chr(3), ''))) OVER w - length(replace(p, chr(3), '')) AS c,
         sum(strlen(replace(p, chr(3), ''))) OVER w - strlen(replace(p, chr(3), '')) AS b
  FROM {name}_piece WINDOW w AS (PARTITION BY {key} ORDER BY k)
), {name} AS (
  SELECT * FROM {name}_at WHERE hit IS NOT NULL {having}
)"""


def skipped(table: str, key: str, more: tuple[str, ...] = ()) -> str:
    """CTEs whose last, `skip`, has (key, s, e): the merged byte ranges of all patterns."""
    out, names = [], []
    for n, pattern in enumerate((*DEFAULT_SKIP, *(f"(?m){p}" for p in more))):
        names.append(f"s{n}")
        # A run of hexadecimal signs between word boundaries that has a digit; the look-ahead says no more.
        plain = pattern.replace("(?=[a-fA-F]*[0-9])", "") if n == HEX else pattern
        out.append(matches(f"s{n}", table, key, _quoted(plain), "AND regexp_matches(hit, '[0-9]')" if n == HEX else ""))
    hits = " UNION ALL ".join(f"SELECT {key}, b AS s, b + strlen(hit) AS e FROM {n}" for n in names)
    return f"""{', '.join(out)}, hit AS ({hits}), reach AS (
  SELECT *, coalesce(s > max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM hit
), island AS (
  SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach
), skip AS (
  SELECT {key}, min(s) AS s, max(e) AS e FROM island GROUP BY {key}, island
)"""


def candidates(table: str, key: str, more: tuple[str, ...] = (), parts_of: str | None = None) -> str:
    """CTEs whose last, `candidate`, has (key, word, c, b): all words that are checked, outside skipped ranges.

    With `parts_of`, `table` (key, owner, base, text) has regions of the texts of that table (owner, text), each cut
    by itself; ranges are those of whole texts.
    """
    marked = "hit"
    for p in _CUTS:
        marked = rf"regexp_replace({marked}, '{p}', '\1' || chr(1) || '\2', 'g')"
    if parts_of:
        outside = lambda row, length: f"NOT EXISTS (SELECT 1 FROM skip, {table} a WHERE a.{key} = {row}.{key} AND skip.owner = a.owner AND a.base + {row}.b >= skip.s AND a.base + {row}.b + {length} <= skip.e)"
    else:
        outside = lambda row, length: f"NOT EXISTS (SELECT 1 FROM skip WHERE skip.{key} = {row}.{key} AND {row}.b >= skip.s AND {row}.b + {length} <= skip.e)"
    return rf"""{skipped(parts_of or table, 'owner' if parts_of else key, more)}, {matches("token", table, key, TOKEN, r"AND regexp_matches(hit, '\p{L}')")}, kept AS (
  SELECT * FROM token WHERE {outside('token', 'strlen(hit)')}
), parts AS (
  SELECT {key}, k, c, b, regexp_extract_all({marked}, '\x01|[_.:]+|[^\x01_.:]+') AS p FROM kept
), part AS (
  SELECT {key}, k, c, b, unnest(range(len(p))) AS i, unnest(p) AS p FROM parts
), placed AS (
  SELECT {key}, p AS word, c + sum(length(replace(p, chr(1), ''))) OVER w - length(replace(p, chr(1), '')) AS c, b + sum(strlen(replace(p, chr(1), ''))) OVER w - strlen(replace(p, chr(1), '')) AS b
  FROM part WINDOW w AS (PARTITION BY {key}, k ORDER BY i)
), candidate AS (
  SELECT * FROM placed WHERE NOT regexp_matches(word, '^[\x01_.:]') AND NOT regexp_matches(word, '\p{{N}}') AND {outside('placed', 'strlen(word)')}
)"""


#: Line and column from 1 of a place that begins after `c` characters of `text`.
LINE_COL = r"length(text[1 : c]) - length(replace(text[1 : c], chr(10), '')) + 1 AS line, length(regexp_extract(text[1 : c], '[^\n]*$')) + 1 AS col"


def html_regions() -> str:
    """CTEs whose last, `region`, has (owner, tag, language, s, e) of `page` (owner, text).

    Text between elements that is not blank, comments, and quoted values of attributes; in scripts and styles of the
    pages' kind, the declared variable, its string, and the properties.
    """
    element = matches("element", "page", "owner", "(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<[!/?a-zA-Z][^>]*>")
    return element + r""", quoted AS (
  SELECT owner, k, b, unnest(range(len(q))) AS i, unnest(q) AS v FROM (SELECT owner, k, b, string_split(hit, '"') AS q FROM element WHERE NOT regexp_matches(hit, '^<(!--|script|style)'))
), valued AS (
  SELECT owner, i, v, b + i + sum(strlen(v)) OVER (PARTITION BY owner, k ORDER BY i) - strlen(v) AS s FROM quoted
), region AS (
  SELECT owner, 'string' AS tag, 'HTML' AS language, b + strlen(coalesce(hit, '')) AS s, b + strlen(coalesce(hit, '')) + strlen(gap) AS e FROM element_at WHERE regexp_matches(gap, '\S')
  UNION SELECT owner, 'comment', 'HTML', b, b + strlen(hit) FROM element WHERE hit LIKE '<!--%'
  UNION SELECT owner, 'string', 'HTML', s, s + strlen(v) FROM valued WHERE i % 2 = 1 AND v <> ''
  UNION SELECT owner, 'identifier.variable', 'Typescript', b + strpos(hit, 'var ') + 3, b + strpos(hit, 'var ') + 3 + strlen(regexp_extract(hit, 'var (\w+)', 1)) FROM element WHERE hit LIKE '<script>var %'
  UNION SELECT owner, 'string', 'Typescript', b + strpos(hit, '"'), b + strpos(hit, '"') + strlen(regexp_extract(hit, '"([^"]*)"', 1)) FROM element WHERE hit LIKE '<script>%"%'
  UNION SELECT owner, 'identifier.field', 'Css', b + strpos(hit, '{'), b + strpos(hit, '{') + strlen(regexp_extract(hit, '\{([\w-]+):', 1)) FROM element WHERE hit LIKE '<style>%{%'
)""".replace("\\\\", "\\")
