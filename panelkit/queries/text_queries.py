"""Text rows, samples, pairs, prompts, vocabularies and encodings."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from ..functions.draws import share_limit
from ..operators import evaluate, labels, report, sampling, textrows, vocab
from ..plans import jobs
from ..sources import files
from ..sources.staging import stage
from . import tables as t
from .registry import query, r6, table

def words_sql(c: str) -> str:
    """SQL text of the word list of a column."""
    return f"list_filter(string_split_regex({c}, '{tx.flat_class("isspace")}+'), lambda w: w <> '')"


GRID_SQL = f"""WITH {t.PANEL_SQL}, feats AS (SELECT DISTINCT feature, ord FROM panel),
ids AS (SELECT DISTINCT id FROM panel),
grid AS (SELECT ids.id, f.feature, f.ord, p.value FROM ids CROSS JOIN feats f
         LEFT JOIN panel p ON p.id = ids.id AND p.feature = f.feature)"""


@query("render_pairs_plain", f"""WITH {t.PANEL_SQL}
SELECT id, string_agg(concat(feature, ' ', CAST(trunc(value) AS BIGINT), ' '), '' ORDER BY ord) AS text FROM panel GROUP BY id""")
def render_pairs_plain(spark, sf):
    return textrows.render_rows(t.panel(spark, sf), "id", t.PANEL_FEATURES, "plain")


@query("render_pairs_comma", f"""WITH {t.PANEL_SQL}
SELECT id, string_agg(concat(feature, ' ', CAST(trunc(value) AS BIGINT), ' , '), '' ORDER BY ord) AS text FROM panel GROUP BY id""")
def render_pairs_comma(spark, sf):
    return textrows.render_rows(t.panel(spark, sf), "id", t.PANEL_FEATURES, "comma")


@query("render_pairs_raw", GRID_SQL + """
SELECT id, string_agg(concat(feature, ' ', coalesce(CAST(value AS VARCHAR), 'nan'), ' , '), '' ORDER BY ord) AS text
FROM grid GROUP BY id""")
def render_pairs_raw(spark, sf):
    return textrows.render_rows(t.panel(spark, sf), "id", t.PANEL_FEATURES, "raw")


TOKEN_SQL = GRID_SQL + """, rows AS (
  SELECT id, string_agg(concat(feature, '_', coalesce(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR), '#'), ' '), '' ORDER BY ord) AS text
  FROM grid GROUP BY id)"""


@query("render_pairs_token", TOKEN_SQL + " SELECT id, text FROM rows")
def render_pairs_token(spark, sf):
    return textrows.render_rows(t.panel(spark, sf), "id", t.PANEL_FEATURES, "token")


@query("render_chunks", f"""WITH {t.PANEL_SQL}, c AS (
  SELECT (ord - 1) // 7 AS chunk_index, feature, ord FROM (SELECT DISTINCT feature, ord FROM panel)),
x AS (SELECT chunk_index, id, string_agg(concat(feature, ' ', CAST(trunc(value) AS BIGINT), ' , '), '' ORDER BY c.ord) AS text
      FROM panel JOIN c USING (feature) GROUP BY 1, 2)
SELECT chunk_index, id, text FROM x QUALIFY count(*) OVER (PARTITION BY chunk_index) >= 1000""")
def render_chunks(spark, sf):
    panel = t.panel(spark, sf)
    feats = panel.select("feature", "ord").distinct()
    chunks = feats.groupBy(F.floor((F.col("ord") - 1) / 7).alias("chunk_index")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "feature")))["feature"].alias("chunk")
    )
    return textrows.render_chunks(panel, "id", chunks, "comma", min_rows=1000)


# The test panel has 28 features, so a sample takes 4 to 9 of them.
N_SAMPLES, MIN_FEATURES, MAX_FEATURES = 20, 4, 9


def subsets_sql(n_samples: int) -> str:
    """CTEs down to ``rows`` (id, sample_no, text)."""
    def draw(*parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws(':', '7', {', '.join(parts)})), 1, 12))::BIGINT"

    return f"""WITH RECURSIVE {t.PANEL_SQL}, f AS (
  SELECT *, CASE WHEN feature LIKE 'cm%' OR feature LIKE 'cf%' THEN 'constructed' ELSE 'raw' END AS part,
         row_number() OVER (PARTITION BY id, part ORDER BY ord) - 1 AS p FROM panel WHERE value >= 0),
n AS (SELECT id, count(*) FILTER (part = 'constructed') AS nc, count(*) FILTER (part = 'raw') AS nr FROM f GROUP BY id),
s AS (SELECT id, nc, nr, unnest(range(1, {n_samples + 1})) AS sample_no FROM n),
z AS (SELECT *, {MIN_FEATURES} + {draw("'size'", 'id', 'sample_no')} % {MAX_FEATURES - MIN_FEATURES + 1} AS size FROM s),
k AS (SELECT *, least(CAST(ceil(size / 3) AS BIGINT), nc) AS kc, least(size - kc, nr) AS kr FROM z),
d AS (SELECT id, sample_no, part, CASE WHEN part = 'raw' THEN nr ELSE nc END AS m, CASE WHEN part = 'raw' THEN kr ELSE kc END AS k
      FROM k, (VALUES ('constructed'), ('raw')) AS parts(part)),
w AS (SELECT *, 0 AS i, []::BIGINT[] AS picks FROM d
  UNION ALL SELECT id, sample_no, part, m, k, i + 1, list_append(picks, CASE WHEN list_contains(picks, t) THEN j ELSE t END)
  FROM (SELECT *, m - k + i AS j, {draw('part', 'id', 'sample_no', 'm - k + i')} % (m - k + i + 1) AS t FROM w WHERE i < k)),
r AS (SELECT id, sample_no, part, unnest(picks) AS p FROM w WHERE i = k),
rows AS (SELECT id, sample_no, string_agg(concat(feature, ' ', CAST(trunc(value) AS BIGINT), ' '), '' ORDER BY ord) AS text
         FROM r JOIN f USING (id, part, p) GROUP BY 1, 2)"""


@query("feature_subsets", subsets_sql(N_SAMPLES) + " SELECT id, sample_no, text FROM rows")
def feature_subsets(spark, sf):
    return jobs.sampled_corpus(t.panel(spark, sf), "id", N_SAMPLES, MIN_FEATURES, MAX_FEATURES, seed=7, together=True)


@query("systematic_sample", "SELECT event_id, user_id, value FROM events WHERE (event_id + 1) % 100 = 0")
def systematic_sample(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return files.systematic(ev, "event_id", 100)


@query("shuffled_order", """SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id))) AS row_no FROM documents""")
def shuffled_order(spark, sf):
    from ..operators.ordering import number_shuffled

    return number_shuffled(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 42)


@query("shuffle", "SELECT doc_id, md5(concat_ws(':', '42', doc_id)) AS draw FROM documents")
def shuffle(spark, sf):
    from ..functions.draws import draw_key

    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.shuffle(docs, ["doc_id"], 42).withColumn("draw", draw_key(42, "doc_id"))


def _ranked(name: str, seed: str) -> str:
    return f"""{name} AS (SELECT user_id AS id, event_id, round(value * 100) AS score,
  row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', '{seed}', user_id, event_id))) AS rank FROM events)"""


@query("sample_k_per_id", f"WITH {_ranked('r', '3')} SELECT id, event_id, rank FROM r WHERE rank <= 10")
def sample_k_per_id(spark, sf):
    rows = t.user_scores(spark, sf).select("id", "event_id")
    return sampling.sample_k_per_id(rows, "id", ["event_id"], 10, 3).select("id", "event_id", "rank")


SWEEP_SQL = f"""WITH {_ranked('r', '3')}, {t.USER_SQL}, ks AS (SELECT unnest([1, 5, 10, 20]) AS k),
means AS (SELECT k, id, avg(score) AS d FROM r JOIN ks ON rank <= k GROUP BY k, id),
sweep AS (SELECT k, task, {t.r2_sql('(prediction + d)', 'truth', 'ybar_train')} AS R
          FROM means JOIN user_residuals USING (id) GROUP BY k, task)"""


def _sweep(spark, sf):
    return evaluate.k_sweep(
        t.user_scores(spark, sf), t.user_residuals(spark, sf), [1, 5, 10, 20], ["event_id"], 3
    )


@query("k_sweep", SWEEP_SQL + " SELECT k, task, round(R, 6) AS R FROM sweep")
def k_sweep(spark, sf):
    return _sweep(spark, sf).select("k", "task", r6("R", "R"))


@query("pivot_k", SWEEP_SQL + """
SELECT task, round(max(R) FILTER (k = 1), 6) AS "1", round(max(R) FILTER (k = 5), 6) AS "5",
  round(max(R) FILTER (k = 10), 6) AS "10", round(max(R) FILTER (k = 20), 6) AS "20" FROM sweep GROUP BY task""")
def pivot_k(spark, sf):
    return report.pivot_k(_sweep(spark, sf).withColumn("R", F.round("R", 6)), [1, 5, 10, 20])


@query("short_ids", "SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) < 60")
def short_ids(spark, sf):
    return sampling.short_ids(table(spark, sf, "events"), "user_id", 60)


def _below(seed: str, keys: str, share: float) -> str:
    return f"substr(md5(concat_ws(':', '{seed}', {keys})), 1, 8) < '{share_limit(share)}'"


@query("hash_split", f"""SELECT event_id, CASE WHEN {_below('42', 'user_id', 0.1)} THEN 'test' ELSE 'train' END AS split FROM events""")
def hash_split(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return sampling.hash_split(ev, ["user_id"], 0.1, 42).drop("user_id")


@query("row_split", f"""SELECT event_id, CASE WHEN {_below('42', 'event_id', 0.05)} THEN 'test' ELSE 'train' END AS split FROM events""")
def row_split(spark, sf):
    return sampling.hash_split(table(spark, sf, "events").select("event_id"), ["event_id"], 0.05, 42)


@query("ordered_split", """WITH ids AS (SELECT DISTINCT user_id FROM events),
r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rn, count(*) OVER () AS n FROM ids)
SELECT event_id, user_id, CASE WHEN rn <= ceil(0.9 * n) THEN 'train' ELSE 'eval' END AS split FROM events JOIN r USING (user_id)""")
def ordered_split(spark, sf):
    return sampling.ordered_split(table(spark, sf, "events").select("event_id", "user_id"), "user_id", 0.9)


@query("bernoulli_lines", f"SELECT doc_id, text FROM documents WHERE {_below('1', 'doc_id', 0.01)}")
def bernoulli_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sampling.bernoulli(docs, ["doc_id"], 0.01, 1)


@query("label_fanout", """WITH l AS (SELECT doc_id, 'quality' AS task, quality AS label FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
SELECT conv_id, turn, task, label::DOUBLE AS label FROM conversations JOIN l ON doc_id = conv_id WHERE label IS NOT NULL""")
def label_fanout(spark, sf):
    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("conv_id"),
        F.inline(F.array(
            F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label")),
            F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label")),
        )),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return labels.fan_out_labels(lab, rows, "conv_id", "task", "label")


@query("cast_label", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN trunc(c_acctbal) ELSE c_acctbal END AS label FROM customer""")
def cast_label(spark, sf):
    from ..functions.codes import cast_label as cast

    return table(spark, sf, "customer").select(
        "c_custkey", cast("c_mktsegment", "c_acctbal", ["BUILDING", "MACHINERY"]).alias("label")
    )


@query("uncovered_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered_ids(spark, sf):
    return labels.uncovered_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("rows_of_ids", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT doc_id FROM labels)")
def rows_of_ids(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"))
    return labels.rows_of_ids(ids, table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query("remaining_work", """SELECT o_orderkey FROM orders WHERE o_orderkey >= 100
 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def remaining_work(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return files.remaining_work(
        table(spark, sf, "orders").select("o_orderkey"), li.where("l_returnflag = 'R'"), ["o_orderkey"],
        available=li, start=F.col("o_orderkey") >= 100,
    )


@query("mask_numbers", f"""SELECT doc_id, regexp_replace(text, '\\*?{tx.flat_class("isdigit")}+', '*', 'g') AS masked_text FROM documents""")
def mask_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.mask_numbers("text").alias("masked_text"))


@query("number_after_word", f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
p AS (SELECT doc_id, w, word, list_position(w, word) AS i FROM d, (SELECT unnest(['ble', 'with', 'de', 'this', 'und']) AS word)),
n AS (SELECT doc_id, word, CASE WHEN i > 0 AND regexp_full_match(w[i + 1], '[0-9]+') THEN CAST(w[i + 1] AS DOUBLE) END AS number FROM p)
SELECT doc_id, word, number FROM n""")
def number_after_word(spark, sf):
    listed = F.explode(F.array(*[F.lit(w) for w in ("ble", "with", "de", "this", "und")]))
    docs = table(spark, sf, "documents").select("doc_id", "text", listed.alias("word"))
    return docs.select("doc_id", "word", tx.number_after("text", F.col("word")).alias("number"))


@query("match_rate", f"""WITH d AS (SELECT lang, {words_sql('text')} AS w FROM documents)
SELECT lang, count(*) AS n_records, count(*) FILTER (list_position(w, 'de') > 0) AS n_matches,
       round(avg(CASE WHEN list_position(w, 'de') > 0 THEN 1.0 ELSE 0 END), 6) AS match_share FROM d GROUP BY lang""")
def match_rate(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    out = textrows.match_rate(docs, F.array_position(tx.words("text"), "de") > 0, ["lang"])
    return out.withColumn("match_share", F.round("match_share", 6))


def _records(spark, sf):
    """Events as nested records: two named fields, the second always 'k <n>'."""
    props = F.translate("props", '{}":', "")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("rec_id"),
        F.struct(
            F.struct(
                F.array(F.col("event_type"), F.lit("death_date")).alias("column_header"),
                F.array(F.concat(F.lit("born "), props), F.concat(F.lit("aged "), F.substring(props, 3, 9))).alias("content"),
            ).alias("table")
        ).alias("input_text"),
        F.concat(F.lit("user "), "user_id", F.lit(" paid "), F.col("value").cast("string")).alias("target_text"),
    )


RECORDS_SQL = f"""r AS (SELECT event_id AS rec_id, concat('user ', user_id, ' paid ', CAST(value AS VARCHAR)) AS text,
 CAST(substr(translate(props, '{{}}":', ''), 3, 9) AS DOUBLE) AS label FROM events),
l AS (SELECT rec_id, text, regexp_replace(text, '\\*?[0-9]+', '*', 'g') AS masked_text, label FROM r)"""


@query("labelled_records", f"WITH {RECORDS_SQL} SELECT * FROM l")
def labelled_records(spark, sf):
    return textrows.labelled_texts(_records(spark, sf))


@query("nested_first_match", f"""WITH d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, lang, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
m AS (SELECT doc_id, i, line FROM x WHERE len({words_sql('line')}) > 12)
SELECT doc_id, i AS line_no, line FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN
 (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1) USING (doc_id)""")
def nested_first_match(spark, sf):
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line"))
    )
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hit = tx.first_match(lines, lambda p: F.size(tx.words(p["line"])) > 12)
    return docs.select("doc_id", hit.alias("m")).select("doc_id", "m.line_no", "m.line")


PAIRS_SQL = """WITH r AS (
  SELECT doc_id, text, n_chars AS y, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id))) AS rn FROM documents),
p AS (SELECT (rn - 1) // 2 AS pair, min_by(text, y) AS short_text, max_by(text, y) AS long_text, min(y) AS lo, max(y) AS hi
      FROM r GROUP BY 1 HAVING count(*) = 2 AND min(y) <> max(y)),
n AS (SELECT *, row_number() OVER (ORDER BY pair) AS pair_no FROM p)"""


@query("pair_rows", PAIRS_SQL + """
SELECT pair_no, CAST((pair_no - 1) % 2 AS INT) AS label, hi - lo AS diff,
  CASE WHEN pair_no % 2 = 1 THEN concat('Person 0: ', short_text, chr(10), 'Person 1: ', long_text)
       ELSE concat('Person 0: ', long_text, chr(10), 'Person 1: ', short_text) END AS pair_texts FROM n""")
def pair_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return textrows.pair_rows(docs, "doc_id", "text", "n_chars", 42)


@query("pair_rows_separator", PAIRS_SQL + """
SELECT pair_no, CAST((pair_no - 1) % 2 AS INT) AS label, hi - lo AS diff,
  CASE WHEN pair_no % 2 = 1 THEN concat(short_text, ' ', chr(10), ' [SEP] ', long_text)
       ELSE concat(long_text, ' ', chr(10), ' [SEP] ', short_text) END AS pair_texts FROM n""")
def pair_rows_separator(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return textrows.pair_rows(docs, "doc_id", "text", "n_chars", 42, "separator")


@query("life_span_pairs", f"""WITH {RECORDS_SQL}, r2 AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', rec_id))) AS rn FROM l WHERE label > 0 AND label < 100),
p AS (SELECT (rn - 1) // 2 AS pair, min_by(masked_text, label) AS short_text, max_by(masked_text, label) AS long_text,
             min(label) AS lo, max(label) AS hi
      FROM r2 GROUP BY 1 HAVING count(*) = 2 AND min(label) <> max(label)),
n AS (SELECT *, row_number() OVER (ORDER BY pair) AS pair_no FROM p)
SELECT pair_no, CAST((pair_no - 1) % 2 AS INT) AS label, hi - lo AS diff,
  CASE WHEN pair_no % 2 = 1 THEN concat('Person 0: ', short_text, chr(10), 'Person 1: ', long_text)
       ELSE concat('Person 0: ', long_text, chr(10), 'Person 1: ', short_text) END AS pair_texts FROM n""")
def life_span_pairs(spark, sf):
    return jobs.life_span_pairs(_records(spark, sf))


@query("prompt_pack", f"""WITH d AS (SELECT doc_id, text, n_chars, len({words_sql('text')}) AS n_words FROM documents),
c AS (SELECT *, sum(n_words + 3) OVER (ORDER BY doc_id) AS upto, row_number() OVER (ORDER BY doc_id) AS row_no FROM d),
e AS (SELECT min(row_no) AS stop FROM c WHERE upto - 3 > 3000)
SELECT doc_id, row_no, n_words, concat(text, chr(10), 'life span: ', n_chars, chr(10), chr(10)) AS prompt
FROM c, e WHERE stop IS NULL OR row_no < stop""")
def prompt_pack(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return textrows.pack_prompt(docs, "doc_id", "text", "n_chars")


AUTHORS_SQL = f"""WITH d AS (SELECT source, {words_sql('text')} AS w FROM documents),
a AS (SELECT source, unnest(list_transform(generate_series(1, len(w), 2), lambda i: array_to_string(w[i:i + 1], ' '))) AS author FROM d),
f AS (SELECT author, count(*) AS n_papers FROM a GROUP BY author)"""


def _papers(spark, sf):
    """Documents as papers: every two words are the name parts of an author.

    The words are bound to a lambda variable, so they are split once per text
    and not once per author.
    """

    def in_twos(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(2))
        return F.transform(starts, lambda i: F.slice(w, i, 2))

    parts = F.get(F.transform(F.array(tx.words("text")), in_twos), F.lit(0))
    return table(spark, sf, "documents").select(
        "source", F.filter(parts, lambda p: F.size(p) > 0).alias("authors_parsed")
    )


@query("author_freq", AUTHORS_SQL + " SELECT author, n_papers FROM f")
def author_freq(spark, sf):
    return textrows.author_frequency(_papers(spark, sf))


@query("freq_of_freq", AUTHORS_SQL + " SELECT n_papers, count(*) AS n_authors FROM f GROUP BY 1")
def freq_of_freq(spark, sf):
    return textrows.frequency_of_frequency(textrows.author_frequency(_papers(spark, sf)))


@query("author_freq_by_source", AUTHORS_SQL + " SELECT source, author, count(*) AS n_papers FROM a GROUP BY 1, 2")
def author_freq_by_source(spark, sf):
    return textrows.author_frequency(_papers(spark, sf), by=["source"])


VOCAB_SIZE = vocab.VOCAB_SIZE
MAX_LENGTH = vocab.MAX_LENGTH


def encode_sql(keys: str) -> str:
    """CTEs from ``rows`` (keys, text) to ``coded`` (keys, input_ids)."""
    return f"""tok AS (
  SELECT {keys}, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS token,
         generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) AS pos FROM rows),
cnt AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 4 AS vid FROM cnt
          QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_SIZE - 5}),
enc AS (SELECT {keys}, list(coalesce(vid, 0) ORDER BY pos) AS body FROM tok LEFT JOIN vocab USING (token)
        WHERE pos <= {MAX_LENGTH - 2} GROUP BY {keys}),
coded AS (SELECT {keys}, list_concat([2], body, [3], list_transform(range({MAX_LENGTH - 2} - len(body)), lambda x: 1)) AS input_ids FROM enc)"""


def mask_sql(keys: str, seed: str) -> str:
    """CTEs from ``coded`` to ``masked`` (keys, input_ids, labels as text)."""
    return f"""x AS (
  SELECT {keys}, unnest(input_ids) AS tid, generate_subscripts(input_ids, 1) - 1 AS i FROM coded),
h AS (SELECT *, tid NOT IN (1, 2, 3) AND {_below(seed, f"'pick', {keys}, i", 0.15)} AS chosen,
             substr(md5(concat_ws(':', '{seed}', 'fate', {keys}, i)), 1, 8) AS fate,
             ('0x' || substr(md5(concat_ws(':', '{seed}', 'token', {keys}, i)), 1, 12))::BIGINT % {VOCAB_SIZE} AS other FROM x),
masked AS (SELECT {keys}, string_agg(CAST(CASE WHEN NOT chosen THEN tid WHEN fate < '{share_limit(0.8)}' THEN 4
                           WHEN fate < '{share_limit(0.9)}' THEN other ELSE tid END AS VARCHAR), ' ' ORDER BY i) AS input_ids,
       string_agg(CAST(CASE WHEN chosen THEN tid ELSE -100 END AS VARCHAR), ' ' ORDER BY i) AS labels
FROM h GROUP BY {keys})"""


VOCAB_SQL = TOKEN_SQL + ", " + encode_sql("id")


def _texts(spark, sf):
    return stage(textrows.render_rows(t.panel(spark, sf), "id", t.PANEL_FEATURES, "token"), "texts")


def _vocab(texts):
    return stage(vocab.top_vocab(vocab.token_counts(texts), VOCAB_SIZE), "vocab")


@query("word_vocab", VOCAB_SQL + """
SELECT token, vid AS id, n FROM vocab
UNION ALL SELECT unnest(['[UNK]', '[PAD]', '[CLS]', '[SEP]', '[MASK]']), unnest([0, 1, 2, 3, 4]), NULL""")
def word_vocab(spark, sf):
    return _vocab(_texts(spark, sf))


@query("token_counts", VOCAB_SQL + " SELECT token, n FROM cnt")
def token_counts(spark, sf):
    return vocab.token_counts(textrows.render_rows(t.panel(spark, sf), "id", t.PANEL_FEATURES, "token"))


@F.arrow_udf(StringType())
def _spaced(numbers: pa.Array) -> pa.Array:
    return pc.binary_join(numbers.cast(pa.list_(pa.string())), " ")


def _joined(c: str):
    """A list without nulls as text."""
    return _spaced(F.col(c)).alias(c)


@query("encode_fixed", VOCAB_SQL + """
SELECT id, array_to_string(input_ids, ' ') AS input_ids,
 array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = 1 THEN 0 ELSE 1 END), ' ') AS attention_mask,
 array_to_string(list_transform(input_ids, lambda x: CASE WHEN x IN (1, 2, 3) THEN 1 ELSE 0 END), ' ') AS special_tokens_mask
FROM coded""")
def encode_fixed(spark, sf):
    texts = _texts(spark, sf)
    enc = vocab.encode(texts, ["id"], _vocab(texts), MAX_LENGTH)
    return enc.select("id", *[_joined(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


@query("mlm_mask", VOCAB_SQL + ", " + mask_sql("id", "9") + " SELECT id, input_ids, labels FROM masked")
def mlm_mask(spark, sf):
    texts = _texts(spark, sf)
    enc = vocab.encode(texts, ["id"], _vocab(texts), MAX_LENGTH)
    return vocab.mlm_mask(enc, ["id"], VOCAB_SIZE, seed=9).select("id", _joined("input_ids"), _joined("labels"))


@query("decoded_in_source", VOCAB_SQL + """
SELECT count(*) AS n_foreign, (SELECT count(*) FROM coded) AS n_rows FROM (
  SELECT id, unnest(input_ids) AS vid FROM coded) e JOIN vocab v USING (vid)
WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.id = e.id AND tok.token = v.token)""")
def decoded_in_source(spark, sf):
    texts = _texts(spark, sf)
    words = _vocab(texts)
    enc = stage(vocab.encode(texts, ["id"], words, MAX_LENGTH), "encoded")
    foreign = vocab.decoded_in_source(enc, texts, ["id"], words)
    return foreign.agg(F.count("*").alias("n_foreign")).withColumn("n_rows", enc.agg(F.count("*")).scalar())


FLOAT_SQL = tx.FLOAT_PATTERN.replace("'", "''")


@query("truncation_audit", f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
k AS (SELECT doc_id, w, len(w) AS n, least(len(w), 200) AS k,
             list_filter(w[1:200], lambda x: NOT regexp_matches(lower(x), '{FLOAT_SQL}') AND x <> ',') AS names FROM d)
SELECT doc_id, n AS n_words, k AS n_kept, round(CASE WHEN n > 0 THEN (n - k) / n ELSE 0 END, 6) AS lost_share,
       names[len(names)] AS last_name,
       CAST((list_position(w, names[len(names)]) - 1) / 3 >= n / 3 - 1 AS INT) AS complete FROM k""")
def truncation_audit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = vocab.truncation_audit(docs, ["doc_id"], 200)
    return out.withColumn("lost_share", F.round("lost_share", 6)).withColumn("complete", F.col("complete").cast("int"))


@query("float_words", f"""WITH d AS (SELECT lang, unnest({words_sql('text')}) AS w FROM documents)
SELECT lang, count(*) AS n_words, count(*) FILTER (regexp_matches(lower(w), '{FLOAT_SQL}')) AS n_floats FROM d GROUP BY lang""")
def float_words(spark, sf):
    w = table(spark, sf, "documents").select("lang", F.explode(tx.words("text")).alias("w"))
    return w.groupBy("lang").agg(
        F.count("*").alias("n_words"), F.count_if(tx.is_float("w")).alias("n_floats")
    )


@query("drop_blank_lines", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line FROM l WHERE NOT regexp_full_match(line, '{tx.flat_class("isspace")}*')""")
def drop_blank_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return files.drop_blank_lines(lines, "line")


@query("corpus_encoding", subsets_sql(N_SAMPLES) + ", " + encode_sql("id, sample_no") + ", " + mask_sql("id, sample_no", "0") + f"""
SELECT id, sample_no, input_ids, labels, CASE WHEN {_below('0', 'id', 0.05)} THEN 'test' ELSE 'train' END AS split FROM masked""")
def corpus_encoding(spark, sf):
    texts = stage(jobs.sampled_corpus(t.panel(spark, sf), "id", N_SAMPLES, MIN_FEATURES, MAX_FEATURES, seed=7, together=True), "corpus")
    out = jobs.encoded_corpus(texts, ["id", "sample_no"], VOCAB_SIZE, MAX_LENGTH, 0.05, ["id"])
    return out.select("id", "sample_no", _joined("input_ids"), _joined("labels"), "split")
