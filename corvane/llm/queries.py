"""The registered queries of the training-data operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, quality_rules


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import pii

    found = pii.detect(common.table(spark, sf_dir, "documents"))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.BASE),
        common.sha256_utf8(text(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE)))).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import quality_classifier

    docs = common.table(spark, sf_dir, "documents")
    space = quality_classifier.learn(docs, common.table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, space)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import decontamination

    index = decontamination.build_index(common.table(spark, sf_dir, "documents"))
    hits = decontamination.search(index, common.table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        common.sha256_utf8(ids).alias("items_sha256"),
        decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import language

    docs = common.table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import html_text

    found = html_text.extract(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import mixing

    mix = mixing.fair_mix(common.table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import sharding

    placed = sharding.hilbert_shards(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import near_duplicates

    return near_duplicates.join(common.table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import substring_dedup

    return substring_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import exact_dedup

    found = exact_dedup.deduplicate(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex(exact_dedup.DIGEST)).alias("text_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import lexical_search

    index = lexical_search.build_index(common.table(spark, sf_dir, "documents"))
    return lexical_search.search(index, common.table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import prefix_trie

    nodes = prefix_trie.build(common.table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_WORD_LIST = ", ".join("'" + w + "'" for w in sorted({*quality_rules.STOP_WORDS, *(w.capitalize() for w in quality_rules.STOP_WORDS)}))

_OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 1)) AS k, w FROM d WHERE len(w) >= 3),
y AS (SELECT r, k, count(*) OVER (PARTITION BY r, w[k], w[k + 1], w[k + 2]) AS n FROM x),
z AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM y WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT d.r, doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(z.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda v: v IN ({_WORD_LIST}))) AS stop
  FROM d JOIN l USING (r) LEFT JOIN z USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS nw FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / nw BETWEEN 2 AND 20 AND n_symbols / nw <= 0.3 AND (length(t) - length(replace(t, '|', ''))) / nw <= 0.2
  AND length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) / greatest(word_chars, 1) <= 0.5 AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AND stop / nw >= 0.02 AS kept
FROM f"""

_OP9 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT r, list_slice(w, k, k + 4) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a AS r, min(doc_id) AS class_id FROM t JOIN d ON d.r = t.b GROUP BY t.a)
SELECT doc_id, class_id, (SELECT count(*) FROM e WHERE e.a = d.r) AS n_links FROM d JOIN c USING (r)"""


_OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r"""

_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS w FROM documents),
n AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS k, item_id, list_distinct({_TERMS_SQL}) AS w FROM benchmark),
it AS (SELECT k, item_id, unnest(w) AS term FROM i),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), n),
m AS (SELECT r, doc_id, 50 + (50 * len(w)::BIGINT * docs) // terms AS m FROM d, n WHERE len(w) > 0),
s AS (SELECT k, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM it JOIN p USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
t AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM t WHERE rank <= 50"""

# crc32 of a number's decimal digits, a byte and a bit at a time
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substring(conv_id::VARCHAR, k, 1))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, bit: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""

_OP13 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS own FROM t GROUP BY conv_id),
h AS (SELECT o.conv_id, o.own, coalesce(b.own, []) AS base, ({_CRC} % 9)::BIGINT AS h FROM o LEFT JOIN (SELECT conv_id AS base_id, own FROM o) b ON base_id = o.conv_id - o.conv_id % 5),
c AS (SELECT conv_id, list_concat(list_slice(base, 1, h), list_slice(own, h + 1, len(own))) AS s FROM h),
p AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM c),
q AS (SELECT conv_id, n, depth, list_slice(s, 1, depth) AS k, list_slice(s, 1, depth - 1) AS up, s[depth].t AS last FROM p),
g AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, coalesce(strlen(any_value(last)), 0)::BIGINT AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY k, depth),
ch AS (SELECT up AS k, depth - 1 AS depth, count(*)::BIGINT AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN ch ON g.k = ch.k AND g.depth = ch.depth),
a AS (SELECT n_children, n_convs, bytes, k, unnest(range(0, depth + 1)) AS d FROM v),
x AS (SELECT list_slice(k, 1, d) AS k, d AS depth, count(*) FILTER (n_children = 0)::BIGINT AS n_leaves, sum(CASE WHEN len(k) > 0 THEN (n_convs - 1) * bytes ELSE 0 END)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN x ON v.k = x.k AND v.depth = x.depth LEFT JOIN v u ON u.k = v.up AND u.depth = v.depth - 1"""


ORACLES: dict[str, str] = {
    "op11_exact_dedup": _OP11,
    "op12_lexical_search": _OP12,
    "op13_prefix_trie": _OP13,
    "op8_quality_rules": _OP8,
    "op9_jaccard_join": _OP9,
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, rowid_, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rowid_, n, k, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT rowid_, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.rowid_, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT rowid_, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rowid_, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rowid_, k, n FROM m)) GROUP BY rowid_),
t AS (SELECT rowid_, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rowid_, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rowid_)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rowid_) LEFT JOIN t USING (rowid_)""",
    "op6_mixing": f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
l AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS most FROM w),
b AS (SELECT *,
    (sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER up, 0)::BIGINT AS rest,
    (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER up, 0)::BIGINT AS weights
  FROM l WINDOW up AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest / weights AS level, most <= (rest / weights) * weight AS is_full FROM b),
o AS (SELECT arg_min(level, (most / weight, place)) AS level FROM f WHERE NOT is_full),
t AS (SELECT f.source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE weight * o.level END AS target FROM f, o),
q AS (SELECT doc_id, size, source_size, target,
    (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT size, (upto + e * source_size) / target AS f FROM q, (VALUES (0), (1), (2)) AS x(e) WHERE size > 0 AND target > 0),
c AS (SELECT coalesce(max(f), 0) AS cut FROM (SELECT f, sum(sum(size)) OVER (ORDER BY f) AS spent FROM r GROUP BY f)
  WHERE spent <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 AND target > 0 THEN size * (((upto / target) <= cut)::BIGINT + (((upto + source_size) / target) <= cut)::BIGINT
    + (((upto + 2 * source_size) / target) <= cut)::BIGINT) ELSE 0 END AS taken
FROM q, c""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS k, w FROM d WHERE len(w) >= 50),
y AS (SELECT r, doc_id, k, hash(list_slice(w, k, k + 49)) AS h, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS m FROM x),
g AS (SELECT h, m, min(doc_id) AS least FROM y GROUP BY h, m),
z AS (SELECT y.r, y.k FROM y JOIN g USING (h, m) WHERE y.doc_id > g.least),
c AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(k, k + 50)) AS p FROM z) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (r)""",
}
