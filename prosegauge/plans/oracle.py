"""The same results in ANSI-style SQL that DuckDB runs, written relationally.

Where the engine uses one pattern over a whole text, the SQL here unnests chunks,
words and sentences into rows and looks at neighbours with LEAD and LAG; the two
share fixed values but no logic, so each checks the other.
"""

from __future__ import annotations

from prosegauge import fixed
from prosegauge.functions.chars import in_class, literal

HIDDEN, MARK, END = "\ue000", "\ufdd3", "\ufdd2"
_W = fixed.WORD_CHARS
_L = f"[{fixed.LETTER_CHARS}]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


WS = q(fixed.WHITESPACE)
NOT_WS = q(f"[^{fixed.WS}]+")


def lines(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``blocks``: lines that are not blank (key, block from 1, t)."""
    return f"""raw_lines AS (
  SELECT {key}, unnest(string_split(coalesce({text}, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) AS block FROM {table}),
blocks AS (SELECT {key}, block, trim(line, {WS}) AS t FROM raw_lines WHERE trim(line, {WS}) <> '')"""


def _twice(x: str, pattern: str, to: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"
    return x


def _hide_inside(x: str, pattern: str, to: str) -> str:
    """Dots hidden inside what the pattern's marked group matches."""
    split = f"string_split(regexp_replace({x}, {q(pattern)}, {q(to)}, 'g'), {q(MARK)})"
    return f"array_to_string(list_transform({split}, lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, '.', {q(HIDDEN)}) ELSE p END), '')"


def pieces(source: str = "blocks", keys: str = "doc_id, block") -> str:
    """CTE ``pieces``: array of pieces of each block; all but the last are sentences."""
    x = _twice("t", r"(\p{Nd})\.(\p{Nd})", rf"\1{HIDDEN}\2")
    steps = [f"p0 AS (SELECT {keys}, {x} AS t FROM {source})"]
    x = "t"
    for word in fixed.SENTENCE_ABBREVIATIONS:
        x = _twice(x, f"(^|[^{_W}])(?i:{literal(word)})([^{_W}]|$)", rf"\1{word.replace('.', HIDDEN)}\2")
    steps.append(f"p1 AS (SELECT {keys}, {x} AS t FROM p0)")
    mail = rf"[{_W}][{_W}.+\-]*@[{_W}.\-]+\.[{_W}]+"
    x = _hide_inside("t", rf"((?:https?://|www\.)[^{fixed.WS}]+|{mail})", rf"{MARK}\1{MARK}")
    steps.append(f"p2 AS (SELECT {keys}, {x} AS t FROM p1)")
    x = _hide_inside("t", rf"(^|[^{_W}])((?:[A-Za-z]\.){{2,}})", rf"\1{MARK}\2{MARK}")
    steps.append(f"p3 AS (SELECT {keys}, {x} AS t FROM p2)")
    closers = f"[{in_class(fixed.SENTENCE_CLOSERS)}]*"
    steps.append(f"p4 AS (SELECT {keys}, regexp_replace(t, {q(f'{HIDDEN}({closers})$')}, {q('.' + chr(92) + '1')}) AS t FROM p3)")
    ends = q(rf"([.!?]+{closers})([{fixed.WS}]|$)")
    steps.append(
        f"pieces AS (SELECT {keys}, string_split(replace(regexp_replace(t, {ends}, {q(chr(92) + '1' + END + chr(92) + '2')}, 'g'), {q(HIDDEN)}, '.'), {q(END)}) AS p FROM p4)"
    )
    return ",\n".join(steps)


def sentences(keys: str = "doc_id, block") -> str:
    """CTE ``sents`` (keys, sentence from 1, t) and ``frags`` (keys, t) from ``pieces``."""
    return f"""sents AS (
  SELECT {keys}, i AS sentence, trim(x, {WS}) AS t
  FROM (SELECT {keys}, unnest(p[:len(p) - 1]) AS x, generate_subscripts(p[:len(p) - 1], 1) AS i FROM pieces)),
frags AS (SELECT {keys}, trim(p[len(p)], {WS}) AS t FROM pieces WHERE trim(p[len(p)], {WS}) <> '')"""


def tokens(source: str, keys: str, name: str = "toks") -> str:
    """CTE ``name``: (keys, k, j, surface) of the tokens of each unit ``t`` of ``source``."""
    c = name
    numeric = q(r"\p{Nd}+[.)]|\p{Nd}+(?:\.\p{Nd}+)+\.")
    v = f"ltrim(part, {q(fixed.OPENERS)})"
    return f"""{c}_chunks AS (
  SELECT {keys}, unnest(c) AS chunk, generate_subscripts(c, 1) AS k FROM (SELECT {keys}, regexp_extract_all(t, {NOT_WS}) AS c FROM {source})),
{c}_next AS (SELECT *, lead(chunk) OVER (PARTITION BY {keys} ORDER BY k) AS nxt FROM {c}_chunks),
{c}_split AS (
  SELECT *, regexp_split_to_array(chunk, {q("://|[" + in_class(fixed.TOKEN_DELIMITERS) + "]")}) AS pp FROM {c}_next
  WHERE chunk NOT IN {words(fixed.IGNORED_MARKERS)}),
{c}_parts AS (SELECT {keys}, k, chunk, nxt, unnest(pp) AS part, generate_subscripts(pp, 1) AS j, len(pp) AS n FROM {c}_split),
{c}_values AS (
  SELECT {keys}, k, j, {v} AS v, j = n AND (nxt IS NULL OR regexp_matches(nxt, {q('^' + chr(92) + 'p{Lu}')}))
    AND chunk NOT IN {words(fixed.TOKEN_ABBREVIATIONS)} AND NOT regexp_full_match({v}, {numeric}) AS closed
  FROM {c}_parts WHERE part <> ''),
{c}_cores AS (SELECT *, rtrim(v, {q(fixed.CLOSERS)}) AS core FROM {c}_values),
{c} AS (
  SELECT * FROM (
    SELECT {keys}, k, j, rtrim(CASE WHEN closed AND regexp_matches(core, '[.!?]$')
      THEN substr(core, 1, length(core) - 1) || substr(v, length(core) + 1) ELSE v END, {q(fixed.TRAILERS)}) AS surface FROM {c}_cores)
  WHERE surface <> '')"""


def letter_syllables(x: str) -> str:
    """Syllables of a word of letters a to z (an expression, read several times)."""
    groups = f"len(regexp_extract_all({x}, '[aeiouy]+'))"
    silent = (
        f"(({x} LIKE '%e' AND {x} NOT LIKE '%le' AND {x} NOT LIKE '%ye')"
        f" OR ({x} LIKE '%es' AND {x} NOT LIKE '%aes' AND {x} NOT LIKE '%ees' AND {x} NOT LIKE '%oes')"
        f" OR ({x} LIKE '%ed' AND {x} NOT LIKE '%ted' AND {x} NOT LIKE '%ded'))"
    )
    return f"CASE WHEN length({x}) = 0 THEN 0 WHEN length({x}) <= 3 THEN 1 ELSE greatest(1, {groups} - CASE WHEN {silent} AND {groups} > 1 THEN 1 ELSE 0 END) END"


def _letters(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z]', '', 'g')"


def word_syllables(x: str) -> str:
    known = " ".join(f"WHEN lower({x}) = {q(w)} THEN {n}" for w, n in fixed.SYLLABLE_EXCEPTIONS.items())
    return f"CASE {known} ELSE list_sum(list_transform([{_letters(x)}], lambda z: {letter_syllables('z')})) END"


def token_syllables(s: str) -> str:
    """Syllables of the token in column ``s``."""
    core = f"trim({s}, {q(fixed.SYLLABLE_STRIPPED)})"
    v1 = f"regexp_extract_all({core}, {q(fixed.V1_WORD)})"
    number = f"regexp_extract({core}, {q('^' + fixed.NUMERIC + '$')}, 2)"
    digits = f"len(regexp_extract_all({number}, {q(chr(92) + 'p{Nd}')}))"
    uni = f"regexp_extract_all({core}, {q(f'{_L}+(?:[{chr(39)}’-]{_L}+)*')})"
    total = lambda of, e: f"coalesce(list_sum(list_transform({of}, lambda w: {e})), 0)"
    ascii_word = f"list_sum(list_transform([{_letters('w')}], lambda z: {letter_syllables('z')}))"
    return f"""(CASE WHEN {s} IN {words(fixed.IGNORED_MARKERS)} OR {core} = '' THEN 0
    WHEN contains({core}, '@') THEN {total(v1, ascii_word)}
    WHEN regexp_full_match({core}, {q(fixed.NUMERIC)}) THEN greatest(1, {digits} + length({number}) - length(replace({number}, '.', ''))
      + CASE WHEN {core} LIKE '$%' AND {digits} > 1 THEN 1 ELSE 0 END)
    WHEN regexp_matches({core}, {q(r'[\p{Nd}²³¹⁰-⁹]')}) AND regexp_matches({core}, {q(chr(92) + 'p{L}')}) THEN 1
    ELSE {total(uni, word_syllables('w'))} END)::BIGINT"""


def passive(source: str = "sents", keys: str = "doc_id, block, sentence", versions: tuple[int, ...] = (3, 4, 5)) -> str:
    """CTE ``passive`` (keys, ``v3``..., ``rule3``...) of each sentence ``t``."""
    pattern = q("[A-Za-z]+(?:['’][A-Za-z]+)?")
    be = lambda v: fixed.BE_FORMS + (fixed.CONTRACTED_BE if v >= 4 else ())

    def participle(x: str, v: int) -> str:
        listed = f"({x} IN {words(fixed.IRREGULAR_PARTICIPLES)} OR (length({x}) >= 4 AND {x} LIKE '%ed'))"
        return f"({listed} AND {x} NOT IN {words(fixed.NO_PARTICIPLES)})" if v >= 4 else listed

    def between(x: str, v: int) -> str:
        return f"({x} IN {words(fixed.INTERVENING + (('indeed',) if v >= 4 else ()))} OR {x} LIKE '%ly')"

    def step(n: int, v: int) -> str:
        c, following = f"c{n}", f"c{n + 1}"
        states = " OR ".join(f"({c} = {q(w)} AND coalesce({following}, '') IN {words(after)})" for w, after in fixed.STATE_COMPLEMENTS.items())
        refused = (
            f"({c} IN {words(fixed.STATE_ADJECTIVES)} OR {states} OR (there AND {following} IS NOT NULL AND {following} <> 'by')"
            f" OR (w IN {words(fixed.GET_FORMS)} AND {c} IN {words(fixed.GET_RESULTS)}))"
        )
        return f"CASE WHEN {c} IS NULL OR s{n} THEN 0 WHEN {participle(c, v)} THEN CASE WHEN {refused} THEN 0 ELSE 1 END WHEN {between(c, v)} THEN 2 ELSE 0 END"

    def finite(v: int) -> str:
        out = "FALSE"
        for n in range(fixed.FINITE_REACH, 0, -1):
            out = f"CASE ({step(n, v)}) WHEN 1 THEN TRUE WHEN 2 THEN {out} ELSE FALSE END"
        return f"(w IN {words(be(v) + fixed.GET_FORMS)} AND {out})"

    def phrase(v: int) -> str:
        out = "FALSE"
        for n in range(fixed.AS_BY_REACH, 0, -1):
            c = f"c{n}"
            out = f"CASE WHEN {c} IS NULL OR s{n} THEN FALSE WHEN {c} = 'by' THEN TRUE WHEN {between(c, v)} THEN {out} ELSE FALSE END"
        skipped = f" AND w NOT IN {words(fixed.AS_BY_EXCLUDED)}" if v >= 5 else ""
        return f"(coalesce(b1, '') = 'as' AND {participle('w', v)}{skipped} AND {out})"

    reach = range(1, fixed.FINITE_REACH + 2)
    ahead = ", ".join(f"lead(w, {n}) OVER o AS c{n}, lead(stops, {n}) OVER o AS s{n}" for n in reach)
    hits = ", ".join(f"{finite(v)} AS f{v}, {phrase(v)} AS a{v}" for v in versions)
    b, g, a, none = map(q, fixed.PASSIVE_RULES)
    flags = ", ".join(
        f"bool_or(f{v} OR a{v}) AS v{v}, CASE WHEN bool_or(f{v}) THEN CASE WHEN arg_min(w, k) FILTER (f{v}) IN {words(fixed.GET_FORMS)} THEN {g} ELSE {b} END"
        f" WHEN bool_or(a{v}) THEN {a} ELSE {none} END AS rule{v}"
        for v in versions
    )
    outer = ", ".join(f"coalesce(v{v}, FALSE) AS v{v}, coalesce(rule{v}, {none}) AS rule{v}" for v in versions)
    return f"""pw AS (
  SELECT {keys}, k, replace(lower(x), '’', '''') AS w, regexp_matches(gaps[k], '[.;:!?]') AS stops
  FROM (SELECT {keys}, unnest(ws) AS x, generate_subscripts(ws, 1) AS k, gaps
    FROM (SELECT {keys}, regexp_extract_all(t, {pattern}) AS ws, regexp_split_to_array(t, {pattern}) AS gaps FROM {source}))),
pn AS (
  SELECT *, lag(w, 1) OVER o AS b1, coalesce(lag(w, 1) OVER o, '') = 'there' OR coalesce(lag(w, 2) OVER o, '') = 'there' AS there, {ahead}
  FROM pw WINDOW o AS (PARTITION BY {keys} ORDER BY k)),
ph AS (SELECT {keys}, k, w, {hits} FROM pn),
pg AS (SELECT {keys}, {flags} FROM ph GROUP BY {keys}),
passive AS (SELECT {", ".join("s." + x.strip() for x in keys.split(","))}, {outer} FROM {source} s LEFT JOIN pg USING ({keys}))"""


def half_even(x: str, digits: int) -> str:
    """Correct rounding with the same error-free product as the engine."""
    scale = f"1e{digits}::DOUBLE"
    return (
        f"list_transform([{x}], lambda v: list_transform([abs(v)], lambda m: list_transform([(m * 134217729.0::DOUBLE) - ((m * 134217729.0::DOUBLE) - m)], lambda h: "
        f"(CASE WHEN v < 0 THEN -1.0 ELSE 1.0 END)::DOUBLE * ((floor(m * {scale}) + CASE WHEN ((m * {scale} - (floor(m * {scale}) + 0.5::DOUBLE)) + ((h * {scale} - m * {scale}) + (m - h) * {scale})) > 0 "
        f"OR (((m * {scale} - (floor(m * {scale}) + 0.5::DOUBLE)) + ((h * {scale} - m * {scale}) + (m - h) * {scale})) = 0 AND floor(m * {scale}) % 2 = 1) THEN 1 ELSE 0 END) / {scale}))[1])[1])[1]"
    )


def ratios(prefix: str = "") -> str:
    """The five metrics of count columns."""
    w, s, c, y, p = (prefix + n for n in ("readability_word_count", "sentence_count", "character_count", "syllable_count", "passive_sentence_count"))
    d = lambda a, b: f"({a}::DOUBLE / nullif({b}, 0)::DOUBLE)"
    e, g = fixed.EASE, fixed.GRADE
    return f"""{d(w, s)} AS {prefix}words_per_sentence, {d(c, w)} AS {prefix}characters_per_word,
  {e[0]}::DOUBLE - {e[1]}::DOUBLE * {d(w, s)} - {e[2]}::DOUBLE * {d(y, w)} AS {prefix}flesch_reading_ease,
  {g[0]}::DOUBLE * {d(w, s)} + {g[1]}::DOUBLE * {d(y, w)} - {g[2]}::DOUBLE AS {prefix}flesch_kincaid_grade_level,
  {d('100 * ' + p, s)} AS {prefix}passive_sentence_percentage"""


def document_counts(version: int = 5) -> str:
    """CTE ``counts``: one row a document, as ``measure.line_readability``."""
    return f"""{lines()},
{pieces()},
{sentences()},
{tokens("blocks", "doc_id, block", "btoks")},
{tokens("sents", "doc_id, block, sentence")},
{passive(versions=(version,))},
n_words AS (SELECT doc_id, count(*) AS word_count FROM btoks GROUP BY doc_id),
n_sents AS (SELECT doc_id, count(*) AS sentence_count, count(DISTINCT block) AS paragraph_count FROM sents GROUP BY doc_id),
n_frags AS (SELECT doc_id, count(*) AS fragment_count FROM frags GROUP BY doc_id),
n_toks AS (SELECT doc_id, count(*) AS readability_word_count, sum(length(surface)) AS character_count, sum({token_syllables("surface")}) AS syllable_count FROM toks GROUP BY doc_id),
n_passive AS (SELECT doc_id, count(*) FILTER (v{version}) AS passive_sentence_count FROM passive GROUP BY doc_id),
counts AS (
  SELECT doc_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("word_count", "readability_word_count", "sentence_count", "paragraph_count", "fragment_count", "character_count", "syllable_count", "passive_sentence_count"))}
  FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN n_words USING (doc_id) LEFT JOIN n_sents USING (doc_id) LEFT JOIN n_frags USING (doc_id)
    LEFT JOIN n_toks USING (doc_id) LEFT JOIN n_passive USING (doc_id))"""


def v1_units(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``v1_sents`` (key, unit, part, sentence) of the first-generation rule."""
    clean = f"regexp_replace(coalesce({text}, ''), {q(chr(92) + 'r' + chr(92) + 'n|[' + fixed.OTHER_LINE_ENDS + ']')}, chr(10), 'g')"
    mark = q(rf"^(?:[{in_class(fixed.V1_LIST_MARKS)}]|\(?\p{{Nd}}{{1,3}}[.)])[{fixed.WS}]+")
    hidden = "u"
    for word in fixed.V1_ABBREVIATIONS:
        hidden = f"replace({hidden}, {q(word)}, {q(word.replace('.', HIDDEN))})"
    cut = f"regexp_replace({hidden}, {q(rf'([.!?])[{chr(34)}{chr(39)})' + chr(92) + rf']]*[{fixed.WS}]+')}, {q(chr(92) + '1' + END)}, 'g')"
    return f"""v1_lines AS (
  SELECT {key}, trim(x, {WS}) AS t, k FROM (SELECT {key}, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT {key}, string_split({clean}, chr(10)) AS l FROM {table}))),
v1_kinds AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN regexp_matches(t, {mark}) THEN 1 ELSE 2 END AS kind FROM v1_lines),
v1_runs AS (SELECT *, sum(CASE WHEN kind = 2 AND before = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY k) AS unit
  FROM (SELECT *, lag(kind, 1, 0) OVER (PARTITION BY {key} ORDER BY k) AS before FROM v1_kinds)),
v1_text AS (SELECT {key}, unit, min(kind) AS kind, string_agg(t, ' ' ORDER BY k) AS u FROM v1_runs WHERE kind > 0 GROUP BY {key}, unit),
v1_parts AS (SELECT {key}, unit, CASE WHEN kind = 1 THEN [regexp_replace(u, {mark}, '')] ELSE string_split({cut}, {q(END)}) END AS p FROM v1_text),
v1_sents AS (
  SELECT * FROM (SELECT {key}, unit, part, trim(replace(x, {q(HIDDEN)}, '.'), {WS}) AS sentence
    FROM (SELECT {key}, unit, unnest(p) AS x, generate_subscripts(p, 1) AS part FROM v1_parts))
  WHERE len(regexp_extract_all(sentence, {q(fixed.V1_WORD)})) >= 2)"""


def v1_counts(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``v1`` (key, counts) of the first-generation rule."""
    w = f"regexp_extract_all(coalesce({text}, ''), {q(fixed.V1_WORD)})"
    return f"""{v1_units(table, key, text)},
v1_words AS (SELECT {key}, unnest({w}) AS w FROM {table}),
v1_letters AS (SELECT {key}, regexp_replace(lower(w), '[^a-z]', '', 'g') AS x FROM v1_words),
v1_of AS (SELECT {key}, count(*) AS word_count, sum(length(x)) AS character_count, sum({letter_syllables("x")}) AS syllable_count FROM v1_letters GROUP BY {key}),
v1_n AS (SELECT {key}, count(*) AS sentence_count FROM v1_sents GROUP BY {key}),
v1 AS (SELECT {key}, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("word_count", "sentence_count", "character_count", "syllable_count"))}
  FROM (SELECT DISTINCT {key} FROM {table}) LEFT JOIN v1_of USING ({key}) LEFT JOIN v1_n USING ({key}))"""


def _edge_key(t: str) -> str:
    return f"regexp_replace(lower(trim(regexp_replace({t}, {q(f'[{fixed.WS}]+')}, ' ', 'g'), {WS})), '[0-9]+', '#', 'g')"


def source_lines() -> str:
    """CTE ``pl``: lines of documents as pages of their source (doc_id, page,
    line_index from 0, text, line_count), with a head and a foot on every other."""
    return f"""bound AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'Report ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || 'Page ' || doc_id || ' of 9' ELSE text END AS text
  FROM documents),
{lines("bound")},
clean AS (SELECT coalesce(source, 'none') AS doc_id, b.doc_id AS page, block, trim(regexp_replace(t, {q(f'[{fixed.WS}]+')}, ' ', 'g'), {WS}) AS text
  FROM blocks b JOIN documents d ON b.doc_id = d.doc_id),
pl AS (SELECT doc_id, page, text, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block) - 1)::INTEGER AS line_index,
  count(*) OVER (PARTITION BY doc_id, page) AS line_count, {_edge_key("text")} AS key FROM clean)"""


def edges(edge_lines: int) -> str:
    """CTE ``edges`` (doc_id, pattern, pages) of ``pl``."""
    return f"""keys AS (SELECT DISTINCT doc_id, page, text, key FROM pl WHERE line_index < {edge_lines} OR line_index >= greatest(0, line_count - {edge_lines})),
edges AS (SELECT doc_id, key AS pattern, count(*) AS pages FROM keys JOIN (SELECT doc_id, count(DISTINCT page) AS page_count FROM pl GROUP BY doc_id) USING (doc_id)
  WHERE length(key) BETWEEN {fixed.EDGE_MIN_CHARS} AND {fixed.EDGE_MAX_CHARS}
  GROUP BY doc_id, key, page_count HAVING count(*) >= greatest({fixed.EDGE_MIN_PAGES}, ceil(page_count * {fixed.EDGE_PAGE_SHARE}::DOUBLE)))"""


def line_role(t: str = "text", page: str = "page", index: str = "line_index", repeated: str = "FALSE") -> str:
    upper, lower = r"[\p{Lu}\p{Lt}]", r"\p{Ll}"
    cased = r"[\p{Lu}\p{Lt}\p{Ll}]"
    title = (
        f"(regexp_matches({t}, {q(cased)}) AND NOT regexp_matches({t}, {q(cased + upper)}) AND NOT regexp_matches({t}, {q('(^|[^' + cased[1:-1] + '])' + lower)}))"
    )
    capitals = f"(regexp_matches({t}, {q(chr(92) + 'p{Lu}')}) AND NOT regexp_matches({t}, {q('[' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')}))"
    n = f"len(regexp_extract_all({t}, '[A-Za-z]+'))"
    ws = f"[{fixed.WS}]"
    return f"""CASE WHEN {repeated} AND {index} < 1 THEN 'header' WHEN {repeated} THEN 'footer'
    WHEN regexp_full_match(lower({t}), {q(rf"(?:page{ws}+)?" + chr(92) + rf"p{{Nd}}+(?:{ws}+of{ws}+" + chr(92) + "p{Nd}+)?")}) THEN 'navigation'
    WHEN regexp_matches({t}, {q(chr(92) + ".{3,}" + ws + "*" + chr(92) + "p{Nd}+" + ws + "*$")}) THEN 'table_of_contents'
    WHEN regexp_matches({t}, {q(f"^{ws}*(?:[{in_class(fixed.LINE_LIST_MARKS)}]|o|" + chr(92) + "(?" + chr(92) + "p{Nd}{1,3}[.)])" + ws + "+")}) THEN 'list'
    WHEN {n} BETWEEN 1 AND {fixed.HEADING_MAX_WORDS} AND length({t}) <= {fixed.HEADING_MAX_CHARS} AND NOT regexp_matches({t}, '[.?!;:]$')
      AND ({title} OR {capitals}) THEN 'heading'
    WHEN {page} = 1 AND {index} < {fixed.COVER_LINES} THEN 'cover' ELSE 'body' END"""
