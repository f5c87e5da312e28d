"""Registered queries of the training-data operators, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import lookalike, mixing, nearcopy, scanned, tokens, truncation
from pagemill.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Caption items whose rest is lost."""
    judged = truncation.truncated_items(table(spark, d, "paper_content_list"), table(spark, d, "manifests"))
    return judged.filter("cut").select("doc_id", "source_index", "field", "item")


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits by source, field and measure of length."""
    return truncation.storage_limits(truncation.caption_items(table(spark, d, "paper_content_list"), table(spark, d, "manifests")))


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut captions of each source; a null source is taken from the manifest."""
    return truncation.truncation_by_source(truncation.truncated_items(table(spark, d, "paper_content_list"), table(spark, d, "manifests")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces of the printed page, one row for each element and defect."""
    return scanned.found(scanned.label_elements(table(spark, d, "paper_content_list")))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs by package and page."""
    return scanned.paragraphs(scanned.label_elements(table(spark, d, "paper_content_list")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of alike blocks."""
    return nearcopy.near_pairs(table(spark, d, "reader_blocks"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each block with its class of equal texts and its number of links."""
    return nearcopy.copy_classes(table(spark, d, "reader_blocks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each document's text."""
    return tokens.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text decoded from its ids."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the mix."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but differ in characters."""
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class of one look, the documents in it and their different texts."""
    return lookalike.lookalike_classes(table(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text in the consistent form."""
    return lookalike.normalised(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_limits, p1_by_source, p2_found, p2_paragraphs, p5_found, p5_classes, p6_ids, p6_round_trip, p7_mix, p7_shares, p8_found, p8_classes, p8_texts)
}

#: Captions by plain SQL, with expressions of its own.
_P1 = r"""
WITH rows AS (SELECT doc_id, source_index, arg_max(coalesce(source, ''), received_at) AS source, arg_max([image_caption, table_caption], received_at) AS captions
  FROM paper_content_list WHERE doc_id IS NOT NULL AND source_index IS NOT NULL GROUP BY ALL),
named AS (SELECT r.doc_id, r.source_index, coalesce(nullif(r.source, ''), m.backend) AS source, captions FROM rows r
  LEFT JOIN (SELECT package_id, min(backend) AS backend FROM manifests GROUP BY ALL) m ON m.package_id = r.doc_id),
stacked AS (SELECT doc_id, source_index, source, unnest(['image_caption', 'table_caption']) AS field, unnest(captions) AS caption FROM named),
items AS (SELECT doc_id, source_index, source, field, CAST(i - 1 AS INTEGER) AS item, caption[i] AS text,
    list_filter(caption[i + 1:], lambda x: trim(x) <> '')[1] AS following
  FROM (SELECT *, unnest(range(1, len(caption) + 1)) AS i FROM stacked WHERE len(caption) > 0) WHERE caption[i] IS NOT NULL),
texts AS (SELECT *, regexp_matches(text, '(\.{3}|…|�)\s*$') OR regexp_matches(text, '\[\s*(\.{3}|…)\s*\]\s*$') AS marked, NOT regexp_matches(text, '\S') AS blank,
    CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda x: unicode(x)) END AS codes,
    regexp_replace(regexp_replace(text, '\s*\[\s*(\.{3}|…)\s*\]\s*$', ''), '\s*(\.{3}|…|�)\s*$', '') AS body FROM items),
sizes AS (SELECT source, field, unnest(['chars', 'utf8', 'utf16', 'html', 'json', 'crlf']) AS measure, unnest([len(c), strlen(body),
    len(c) + len(list_filter(c, lambda x: x > 65535)),
    len(c) + 4 * len(list_filter(c, lambda x: x = 38)) + 3 * len(list_filter(c, lambda x: x IN (60, 62))) + 5 * len(list_filter(c, lambda x: x IN (34, 39))),
    len(c) + len(list_filter(c, lambda x: x IN (9, 10, 13, 34, 92))) + 5 * len(list_filter(c, lambda x: x > 127)) + 6 * len(list_filter(c, lambda x: x > 65535)),
    len(replace(replace(body, chr(13) || chr(10), chr(10)), chr(10), 'xx'))]) AS n
  FROM (SELECT *, CASE WHEN body = '' THEN [] ELSE list_transform(string_split(body, ''), lambda x: unicode(x)) END AS c FROM texts)),
hist AS (SELECT source, field, measure, n, count(*) AS items FROM sizes GROUP BY ALL),
lim AS (SELECT source, field, measure, n AS store_limit, items AS at_limit FROM (SELECT *, max(n) OVER w AS longest,
    coalesce(sum(items) OVER (PARTITION BY source, field, measure ORDER BY n RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) / 10.0 AS usual
    FROM hist WINDOW w AS (PARTITION BY source, field, measure)) WHERE n = longest AND n >= 40 AND items >= @COUNT@ AND items >= @RATIO@ * usual),
per AS (SELECT source, field, map_from_entries(list((measure, store_limit))) AS l FROM lim GROUP BY ALL),
limited AS (SELECT t.*, coalesce(len(codes) >= l['chars'], false) OR coalesce(strlen(text) + 3 >= l['utf8'], false)
    OR coalesce(len(codes) + len(list_filter(codes, lambda x: x > 65535)) >= l['utf16'], false)
    OR coalesce(len(codes) + 4 * len(list_filter(codes, lambda x: x = 38)) + 3 * len(list_filter(codes, lambda x: x IN (60, 62))) + 5 * len(list_filter(codes, lambda x: x IN (34, 39))) >= l['html'], false)
    OR coalesce(len(codes) + len(list_filter(codes, lambda x: x IN (9, 10, 13, 34, 92))) + 5 * len(list_filter(codes, lambda x: x > 127)) + 6 * len(list_filter(codes, lambda x: x > 65535)) >= l['json'], false)
    OR coalesce(len(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), 'xx')) >= l['crlf'], false) AS at_limit
  FROM texts t LEFT JOIN per p ON p.source IS NOT DISTINCT FROM t.source AND p.field = t.field),
cut AS (SELECT doc_id, source_index, source, field, item, text, following, marked, blank, at_limit,
    NOT marked AND (right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(34) || '”''’»)]'), 1) IN ('.', '!', '?', '。', '！', '？')) AS terminal,
    list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\s*([\p{Lu}][\p{L}]{1,11}[.]?|[\p{Han}])\s*[0-9]+\s*([:|.]\s*|([^\p{Ll}\s0-9])|$)', '\3'),
      '([?!.][)\]»’”''"]*)\s+([^\p{Ll}\s0-9])', '\1~|~\2', 'g'), '([！？。])([^\s])', '\1~|~\2', 'g'), '~|~'), lambda x: trim(x) <> ''),
      lambda x: regexp_extract_all(x, '[\p{Han}]|[^\p{Han}\s]+')) AS sents FROM limited),
each AS (SELECT doc_id, source_index, field, item, unnest(sents) AS words, unnest(range(1, len(sents) + 1)) AS nth, len(sents) AS parts, terminal FROM cut WHERE NOT blank AND NOT marked),
said AS (SELECT *, nth < parts OR terminal AS closed, CASE WHEN nth < parts OR terminal THEN NULL WHEN regexp_matches(words[-1], '[\p{L}]$') THEN 'letter'
    WHEN regexp_matches(words[-1], '[\p{N}]$') THEN 'digit' WHEN right(words[-1], 1) IN (')', ']') THEN 'bracket' ELSE 'sign' END AS ending FROM each),
seen AS (SELECT 'o' AS kind, array_to_string(words[:k], ' ') AS key, closed AS good, ending FROM (SELECT *, unnest(range(1, least(@OPENER@, len(words)) + 1)) AS k FROM said)
  UNION ALL SELECT 'p', left(words[1], k), closed, NULL FROM (SELECT *, unnest(range(2, least(len(words[1]), 25))) AS k FROM said WHERE len(words[1]) > 2)
  UNION ALL SELECT 'w', lower(regexp_replace(regexp_replace(words[k], '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')), k = len(words), NULL FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM said)
  UNION ALL SELECT 'a', words[k], regexp_matches(words[k + 1], '^[0-9\p{Ll}]'), NULL FROM (SELECT *, unnest(range(1, len(words))) AS k FROM said) WHERE suffix(words[k], '.')
  UNION ALL SELECT 's', regexp_replace(trim(text), '[0-9]+', '9', 'g'), false, NULL FROM cut WHERE NOT blank AND NOT marked),
stats AS (SELECT kind, key, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (ending = 'letter') AS letter, count(*) FILTER (ending = 'digit') AS digit,
    count(*) FILTER (ending = 'bracket') AS bracket, count(*) FILTER (ending = 'sign') AS sign FROM seen GROUP BY ALL),
tails AS (SELECT *, sents[-1] AS tail, lower(regexp_replace(regexp_replace(sents[-1][-1], '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')) AS word,
    CASE WHEN regexp_matches(sents[-1][-1], '[\p{L}]$') THEN 'letter' WHEN regexp_matches(sents[-1][-1], '[\p{N}]$') THEN 'digit' WHEN right(sents[-1][-1], 1) IN (')', ']') THEN 'bracket' ELSE 'sign' END AS ending,
    coalesce(NOT regexp_matches(following, '^\s*([\p{Lu}][\p{L}]{1,11}[.]?|[\p{Han}])\s*[0-9]+\s*([^\p{Ll}\s0-9]|$)') AND NOT regexp_matches(following, '^[^0-9A-Za-z_]*([\p{L}]|[xvi]{1,4}|[0-9]{1,2})[^0-9A-Za-z_]*$'), false) AS follows FROM cut),
openers AS (SELECT doc_id, source_index, field, item, arg_max(s, k) AS o FROM (SELECT *, unnest(range(1, least(@OPENER@, len(tail)) + 1)) AS k FROM tails WHERE NOT terminal) t
  JOIN stats s ON s.kind = 'o' AND s.key = array_to_string(t.tail[:k], ' ') AND s.n >= @SUPPORT@ GROUP BY ALL),
facts AS (SELECT t.*, o.good >= 0.5 * o.n AS closed, CASE t.ending WHEN 'letter' THEN o.letter WHEN 'digit' THEN o.digit WHEN 'bracket' THEN o.bracket ELSE o.sign END >= CASE WHEN t.at_limit THEN 0.1 ELSE 0.02 END * (o.letter + o.digit + o.bracket + o.sign) AS usual,
    coalesce(w.n >= 20 AND w.good < 0.02 * w.n, false) AS inside, w.n AS word_n, coalesce(p.n >= @SUPPORT@ AND p.good >= 0.5 * p.n AND w.n < @SUPPORT@, false) AS begun,
    coalesce(a.n >= 3 AND a.good >= 0.5 * a.n, false) AS short, t.follows AND NOT coalesce(s.n >= @ITEMS@, false) AS goes_on,
    len(text) - len(replace(text, '(', '')) > len(text) - len(replace(text, ')', '')) OR len(text) - len(replace(text, '[', '')) > len(text) - len(replace(text, ']', '')) AS unbalanced
  FROM tails t LEFT JOIN openers o USING (doc_id, source_index, field, item) LEFT JOIN stats w ON w.kind = 'w' AND w.key = t.word
  LEFT JOIN stats p ON p.kind = 'p' AND len(t.tail) = 1 AND p.key = t.tail[1] LEFT JOIN stats a ON a.kind = 'a' AND a.key = t.tail[-1]
  LEFT JOIN stats s ON s.kind = 's' AND s.key = regexp_replace(trim(t.following), '[0-9]+', '9', 'g')
    AND NOT (regexp_matches(trim(t.following), '^[\p{Ll}]') AND right(rtrim(t.following, chr(32) || chr(9) || chr(10) || chr(13) || chr(34) || '”''’»)]'), 1) IN ('.', '!', '?', '。', '！', '？'))),
verdicts AS (SELECT *, CASE WHEN blank THEN false WHEN marked THEN true
    WHEN terminal THEN (short OR (at_limit AND regexp_matches(text, '[ \t\n][0-9]+[.]\s*$'))) AND NOT goes_on
    WHEN goes_on THEN false
    WHEN at_limit THEN NOT (coalesce(NOT closed AND usual, false) AND NOT inside AND NOT unbalanced AND coalesce(word_n > 1, false))
    WHEN inside OR unbalanced THEN true WHEN closed IS NOT NULL THEN closed OR NOT usual ELSE len(sents) > 1 OR begun END AS is_cut FROM facts)
""".replace("@COUNT@", str(truncation.LIMIT_COUNT)).replace("@RATIO@", str(truncation.LIMIT_RATIO)).replace("@OPENER@", str(truncation.OPENER)).replace("@SUPPORT@", str(truncation.SUPPORT)).replace("@ITEMS@", str(truncation.ITEMS))

_NEAR = """
WITH last AS (SELECT id, arg_max(fingerprint, received_at) AS f FROM reader_blocks WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT id, lpad(regexp_extract(lower(trim(f.visible_text_sha256)), '^(?:0x)?0*([0-9a-f]{0,64})$', 1), 64, '0') AS sha,
    CAST('0x' || lpad(regexp_extract(lower(trim(f.simhash64)), '^(?:0x)?0*([0-9a-f]{0,16})$', 1), 16, '0') AS UBIGINT) AS sim,
    CAST(f.text_length AS INTEGER) AS len FROM last WHERE f.text_length IS NULL OR f.text_length <> 0),
pairs AS (SELECT a.id AS block_a, b.id AS block_b FROM p a JOIN p b ON a.id < b.id
  WHERE coalesce(a.sha = b.sha, false)
     OR coalesce(bit_count(xor(a.sim, b.sim)) <= 3 AND abs(a.len - b.len) * 10 <= greatest(a.len, b.len), false))
"""

_LETTERS = (lookalike.GREEK, lookalike.CYRILLIC, lookalike.ARMENIAN, lookalike.LISU, lookalike.CHEROKEE, lookalike.SINGLE)
_FROM = "".join((*(x[0] for x in _LETTERS), lookalike.BLANKS, lookalike.HYPHENS, "µ"))
_TO = "".join((*(x[1] for x in _LETTERS), " " * len(lookalike.BLANKS), "-" * len(lookalike.HYPHENS), "μ"))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_GONE = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in lookalike.IGNORABLE)
#: Letters with marks by their consistent form, as the database has no decomposition.
_MARKED = [(chr(c), x) for c in range(0x370, 0x530) if len(x := lookalike.look(chr(c))) == 1 and x != chr(c) and chr(c) not in _FROM]
_FROM, _TO = _FROM + "".join(a for a, _ in _MARKED), _TO + "".join(b for _, b in _MARKED)
_FORM = f"""nfc_normalize(translate(translate(nfc_normalize(regexp_replace(text, '[{_GONE}]', '', 'g')), '{_FROM}', '{_TO}'), '{_WIDE}', '{_PLAIN}'))"""

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT doc_id, source_index, field, item FROM verdicts WHERE is_cut",
    "p1_limits": _P1 + "SELECT * FROM lim",
    "p1_by_source": _P1
    + """SELECT coalesce(source, '') AS source, count(*) AS captions, count(*) FILTER (is_cut) AS cut, count(*) FILTER (is_cut AND at_limit) AS cut_at_limit,
    round(count(*) FILTER (is_cut) / count(*), 6) AS share FROM verdicts WHERE NOT blank GROUP BY 1""",
    "p5_found": _NEAR + "SELECT * FROM pairs",
    "p5_classes": _NEAR
    + """SELECT p.id, min(p.id) OVER (PARTITION BY coalesce(sha, 'id:' || p.id)) AS class_id, coalesce(l.links, 0) AS links
    FROM p LEFT JOIN (SELECT id, count(*) AS links FROM (SELECT block_a AS id FROM pairs UNION ALL SELECT block_b FROM pairs) GROUP BY id) l ON l.id = p.id""",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": f"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
    SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id
    WHERE regexp_matches(a.form, '[^\\s\\pZ\\p{{Cc}}\\p{{Cf}}]')""",
    "p8_classes": f"""WITH f AS (SELECT doc_id, text, md5({_FORM}) AS class_id FROM documents WHERE text IS NOT NULL),
    n AS (SELECT class_id, count(*) AS documents, count(DISTINCT text) AS texts FROM f GROUP BY 1)
    SELECT f.doc_id, class_id, n.documents, n.texts FROM f JOIN n USING (class_id)""",
    "p8_texts": f"SELECT doc_id, {_FORM} AS text, coalesce({_FORM} <> text, false) AS changed FROM documents",
}
