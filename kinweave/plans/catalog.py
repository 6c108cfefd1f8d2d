"""The catalogue: every query by name, with the SQL that gives the same rows where SQL can express it.

Floats are rounded to six places on both sides. The queries without SQL (trained models, approximate neighbours and what
needs phonetic codes) are tested in tests/test_models.py, by recall or against plain code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import address, arrow, lists, text
from kinweave.operators import audit, blocking, decision, dense, features, fusion, metrics, models, normalise, pairs
from kinweave.plans import linkage, views
from kinweave.plans.registry import QUERIES, SQL, query, r6, with_
from kinweave.plans.registry import rounded as _rounded
from kinweave.plans.registry import words as _words
from kinweave.sources import sinks
from kinweave.sources.folders import stored, written

__all__ = ["QUERIES", "SQL"]
V = views


# scans, audit and profiles


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def audit_value_counts(spark, d):
    return audit.value_counts(V.read(spark, d, "documents"), "lang")


@query(with_(V.REC) + "SELECT src::BIGINT AS src, bucket, count(*) AS n FROM rec GROUP BY src, bucket")
def audit_row_counts(spark, d):
    return V.records(spark, d).groupBy("src", "bucket").agg(F.count("*").alias("n"))


@query(with_(V.REC) + "".join(f"{'UNION ALL ' if i else ''}SELECT '{c}' AS \"column\", round(avg(CASE WHEN trim({c}) = '' THEN 100.0 ELSE 0 END), 4) AS missing_pct FROM rec " for i, c in enumerate(("name_core", "addr_norm", "addr_postal", "addr_house_number"))))
def audit_missing_pct(spark, d):
    return audit.missing_share(V.records(spark, d), ["name_core", "addr_norm", "addr_postal", "addr_house_number"])


@query(with_(V.REC, V.GT, V.REFS) + "SELECT CASE WHEN t = 0 THEN '0' WHEN t = 1 THEN '1' ELSE '2+' END AS matches, count(*) AS n_refs FROM (SELECT r.ref_id, count(g.cand_id) AS t FROM refs r LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (ref_id) GROUP BY r.ref_id) GROUP BY 1")
def gt_cardinality(spark, d):
    return audit.cardinality(V.references(spark, d), V.truth(spark, d))


@query(with_(V.REC) + "SELECT count(*) AS pairs, sum(CASE WHEN a.bucket <> b.bucket THEN 1 ELSE 0 END)::BIGINT AS mismatched FROM rec a JOIN rec b ON a.text = b.text WHERE a.src = 1 AND b.src > 1")
def gt_bucket_mismatch(spark, d):
    return audit.twin_mismatch(V.records(spark, d), "text")


@query(r"""SELECT lang, count(*) AS n, round(avg(c), 6) AS mean_chars, median(c)::DOUBLE AS median_chars, max(c)::DOUBLE AS max_chars, round(avg(w), 6) AS mean_words, median(w)::DOUBLE AS median_words, max(w)::DOUBLE AS max_words
FROM (SELECT lang, length(text) AS c, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY lang""")
def text_profile(spark, d):
    p = audit.text_profile(V.read(spark, d, "documents"), "text", "lang")
    return p.withColumns({"mean_chars": F.round("mean_chars", 6), "mean_words": F.round("mean_words", 6)})


# normalisation


@query(with_(V.REC) + "SELECT entity_id, len(toks)::BIGINT AS n_tokens, name_core, addr_norm FROM rec")
def norm_tokens(spark, d):
    return V.records(spark, d).select("entity_id", F.size("toks").cast("long").alias("n_tokens"), "name_core", "addr_norm")


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '&', ' and '), '[^\p{L}\p{N}\p{M}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def norm_punctuation(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.md5(text.punctuation(F.col("text")).cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(regexp_extract_all(text, '\p{Nd}+'))), lambda x: x), ',') AS runs FROM documents""")
def norm_digit_runs(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.digit_runs(F.col("text"))), ",").alias("runs"))


@query(with_(V.REC) + f"SELECT entity_id, array_to_string(CASE WHEN len(k) = 0 THEN toks ELSE k END, ' ') AS kept FROM (SELECT entity_id, toks, list_filter(toks, lambda t: t NOT IN ({_words(lists.STOPWORDS)})) AS k FROM rec)")
def norm_stopwords(spark, d):
    return V.records(spark, d).select("entity_id", F.array_join(text.without_stopwords(F.col("toks")), " ").alias("kept"))


COUNTRIES = "CASE doc_id % 6 WHEN 0 THEN ' USA ' WHEN 1 THEN 'India' WHEN 2 THEN 'FR' WHEN 3 THEN '' WHEN 4 THEN 'U.S.' ELSE 'Brazil' END"


def _country(c):
    n = F.col("doc_id") % 6
    return F.when(n == 0, " USA ").when(n == 1, "India").when(n == 2, "FR").when(n == 3, "").when(n == 4, "U.S.").otherwise("Brazil")


COUNTRY_SQL = "CASE lower(trim(c)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lists.COUNTRY.items()) + " ELSE lower(trim(c)) END"


@query(f"SELECT doc_id, {COUNTRY_SQL} AS country_norm, coalesce(nullif({COUNTRY_SQL}, ''), 'other') AS bucket FROM (SELECT doc_id, {COUNTRIES} AS c FROM documents)")
def norm_country(spark, d):
    return V.read(spark, d, "documents").select("doc_id", text.country(_country("x")).alias("country_norm"), text.bucket(_country("x")).alias("bucket"))


COMPANY = "CASE doc_id % 5 WHEN 0 THEN ' corp' WHEN 1 THEN ' inc' WHEN 2 THEN ' llc' WHEN 3 THEN ' pvt ltd' ELSE '' END"
ABBREV_US = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lists.ABBREVIATIONS["us"].items()) + " ELSE t END"
EXPANDED = f"ex AS (SELECT entity_id, string_split(array_to_string(list_transform(string_split(name_core || {COMPANY}, ' '), lambda t: {ABBREV_US}), ' '), ' ') AS w FROM rec WHERE name_core <> '')"


def _company(spark, d):
    n = F.col("doc_id") % 5
    tail = F.when(n == 0, " corp").when(n == 1, " inc").when(n == 2, " llc").when(n == 3, " pvt ltd").otherwise("")
    rows = V.records(spark, d).where("name_core != ''")
    return rows.select("entity_id", text.expand(text.tokens(F.concat("name_core", tail)), F.lit("us")).alias("w"))


@query(with_(V.REC, EXPANDED) + "SELECT entity_id, array_to_string(w, ' ') AS expanded FROM ex")
def norm_abbreviations(spark, d):
    return _company(spark, d).select("entity_id", F.array_join("w", " ").alias("expanded"))


SUFFIX = "CASE " + " ".join(f"WHEN len(w) >= {k} AND array_to_string(w[-{k}:], ' ') IN ({_words(lists.LEGAL_SUFFIXES['us'])}) THEN array_to_string(w[-{k}:], ' ')" for k in range(5, 0, -1)) + " ELSE '' END"


@query(with_(V.REC, EXPANDED) + f"SELECT entity_id, s AS suffix, array_to_string(w[1:len(w) - CASE s WHEN '' THEN 0 ELSE len(string_split(s, ' ')) END], ' ') AS core FROM (SELECT *, {SUFFIX} AS s FROM ex)")
def norm_legal_suffix(spark, d):
    s = text.legal_suffix(F.col("w"), F.lit("us"))
    return _company(spark, d).select("entity_id", s.alias("suffix"), F.array_join(text.without_suffix(F.col("w"), s), " ").alias("core"))


@query(with_(V.REC) + "SELECT entity_id, strip_accents(name_core) AS plain FROM rec")
def norm_accents(spark, d):
    return V.records(spark, d).select("entity_id", arrow.without_accents(F.col("name_core")).alias("plain"))


INDIC = r"regexp_extract(text, '[\x{0900}-\x{097F}\x{0B80}-\x{0BFF}\x{0C00}-\x{0CFF}]')"


@query(rf"SELECT doc_id, CASE WHEN c BETWEEN chr(2304) AND chr(2431) THEN 'devanagari' WHEN c BETWEEN chr(2944) AND chr(3071) THEN 'tamil' WHEN c BETWEEN chr(3072) AND chr(3199) THEN 'telugu' WHEN c BETWEEN chr(3200) AND chr(3327) THEN 'kannada' WHEN regexp_matches(text, '[A-\x{{24F}}]') THEN 'latin' ELSE 'other' END AS script FROM (SELECT doc_id, text, {INDIC} AS c FROM documents)")
def detect_script(spark, d):
    return V.read(spark, d, "documents").select("doc_id", text.script(F.col("text")).alias("script"))


ADDRESS = r"addr AS (SELECT entity_id, toks || [CASE doc_id % 3 WHEN 0 THEN 'springfield' ELSE 'street' END, CASE doc_id % 4 WHEN 0 THEN 'il' WHEN 1 THEN 'tx' ELSE 'zz' END, (10000 + doc_id)::VARCHAR] AS w FROM rec)"


def _addresses(spark, d):
    n = F.col("doc_id")
    tail = F.array(F.when(n % 3 == 0, "springfield").otherwise("street"), F.when(n % 4 == 0, "il").when(n % 4 == 1, "tx").otherwise("zz"), (10000 + n).cast("string"))
    return V.records(spark, d).select("entity_id", F.concat("toks", tail).alias("w"))


@query(with_(V.REC, ADDRESS) + r"SELECT entity_id, coalesce(regexp_extract_all(array_to_string(w, ' '), '\b\d{5}(?:-\d{4})?\b')[-1], '') AS postal FROM addr")
def addr_postal(spark, d):
    return _addresses(spark, d).select("entity_id", address.postal(F.array_join("w", " "), F.lit("us")).alias("postal"))


@query(with_(V.REC, ADDRESS) + r"SELECT entity_id, coalesce(list_filter(w, lambda t: regexp_full_match(t, '\p{Nd}+(-\p{Nd}+)?'))[1], '') AS house FROM addr")
def addr_house(spark, d):
    return _addresses(spark, d).select("entity_id", address.house_number(F.col("w")).alias("house"))


US_AT = f"list_max(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({_words(lists.STATES['us'])})))"
ALPHA = r"'\p{L}+'"


@query(with_(V.REC, ADDRESS, f"last_state AS (SELECT *, {US_AT} AS i FROM addr)") + rf"""SELECT entity_id, CASE WHEN i > 1 THEN w[i] ELSE '' END AS state,
CASE WHEN i > 1 THEN CASE WHEN NOT regexp_full_match(w[i - 1], {ALPHA}) OR w[i - 1] IN ({_words(lists.STREET_TYPES)}) THEN ''
  WHEN i > 2 AND regexp_full_match(w[i - 2], {ALPHA}) AND w[i - 2] NOT IN ({_words(lists.STREET_TYPES)}) THEN w[i - 2] || ' ' || w[i - 1] ELSE w[i - 1] END
ELSE coalesce(list_filter(w, lambda t: regexp_full_match(t, {ALPHA}))[-1], '') END AS city FROM last_state""")
def addr_state_city(spark, d):
    return _addresses(spark, d).select("entity_id", address.place(F.col("w"), F.lit("us")).alias("place")).select("entity_id", "place.state", "place.city")


CODES = "translate(regexp_replace(upper(t), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
BARE = f"({CODES}[1] || replace({CODES}[2:], '7', ''))"
ONCE = "regexp_replace(" * 6 + BARE + "".join(f", '{x}+', '{x}', 'g')" for x in range(1, 7))
#: Non-ASCII letters are no letters here, as for the function that Spark has.
SOUNDEX = f"CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN upper(t[1]) || rpad(replace(substr({ONCE}, 2), '0', '')[1:3], 3, '0') ELSE '' END"


@query(with_(V.REC) + f"SELECT entity_id, array_to_string(list_transform(list_filter(string_split(name_core, ' '), lambda t: t <> ''), lambda t: {SOUNDEX}), ' ') AS codes FROM rec")
def soundex_codes(spark, d):
    return V.records(spark, d).select("entity_id", F.array_join(F.transform(text.tokens(F.col("name_core")), arrow.soundex), " ").alias("codes"))


@query()
def metaphone_codes(spark, d):
    return V.records(spark, d).select("entity_id", F.array_join(arrow.metaphones(F.col("toks")), " ").alias("codes"))


@query()
def normalised_records(spark, d):
    from kinweave.operators.normalise import normalise

    rec = V.records(spark, d)
    raw = rec.select("entity_id", F.col("name_core").alias("business_name"), F.col("addr_norm").alias("business_address"), _country("x").alias("country"))
    out = normalise(raw)
    return out.select(*[F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])


# retrieval


@query(with_(V.REC, V.EXACT) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM exact")
def block_exact(spark, d):
    return blocking.exact_channel(*V.sides(spark, d))


@query(with_(V.REC, V.WORD) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM word")
def block_word_tfidf(spark, d):
    return blocking.word_channel(*V.sides(spark, d))


def _char_list(spark, d):
    whole = F.trim(F.concat_ws(" ", "name_core", "addr_norm"))
    refs, cands = V.sides(spark, d)
    return blocking.char_channel(refs.withColumn("key", whole), cands.withColumn("key", whole), column="key")


@query(with_(V.REC, V.CHAR) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM chars")
def block_char_tfidf(spark, d):
    return _char_list(spark, d)


COSINE = r"""tf AS (SELECT entity_id, src, bucket, term, count(*) AS tf FROM (SELECT entity_id, src, bucket, unnest(regexp_extract_all(lower(name_core || ' ' || addr_norm), '[\p{L}\p{N}_]{2,}')) AS term FROM rec) GROUP BY ALL),
n AS (SELECT bucket, count(*) AS n FROM rec WHERE src > 1 GROUP BY bucket),
voc AS (SELECT bucket, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf JOIN n USING (bucket) WHERE src > 1 GROUP BY bucket, term, n),
u AS (SELECT entity_id, src, bucket, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM (SELECT *, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (bucket, term))),
s AS (SELECT a.entity_id AS ref_id, b.entity_id AS cand_id, round(sum(a.w * b.w), 9) AS score FROM u a JOIN u b USING (bucket, term) WHERE a.src = 1 AND b.src > 1 GROUP BY ALL)"""


@query(with_(V.REC, COSINE) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, seq) AS rank FROM s JOIN rec ON rec.entity_id = cand_id) WHERE rank <= 50")
def block_sparse_cosine(spark, d):
    refs, cands = (x.withColumn("terms", text.word_terms(F.concat_ws(" ", "name_core", "addr_norm"))) for x in V.sides(spark, d))
    return blocking.sparse_cosine(refs, cands, 50)


@query()
def block_phonetic(spark, d):
    refs, cands = (blocking.phonetic_columns(x, "name_core", "addr_norm") for x in V.sides(spark, d))
    return blocking.phonetic_channel(refs, cands).select("ref_id", "cand_id", r6("score", "score"), "rank")


@query("""SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, seq) AS rank FROM (
  SELECT 'V-' || a.vec_id AS ref_id, 'V-' || b.vec_id AS cand_id, b.vec_id AS seq, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)) WHERE rank <= 50""")
def block_dense_exact(spark, d):
    return dense.exact_knn(*V.vectors(spark, d))


@query()
def block_dense_ivf(spark, d):
    return dense.ivf_knn(*V.vectors(spark, d), k=10, cells=16, probes=12)


# fusion


def _lists(spark, d):
    return linkage.stored_lists(spark, d)


def rrf_sql(k: str, source: str = "lists", name: str = "fused") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS rank FROM (SELECT ref_id, cand_id, round(sum(1.0::DOUBLE / ({k} + rank)), 12) AS score FROM {source} GROUP BY ALL))"


@query(with_(V.CHANNELS, rrf_sql("10")) + "SELECT ref_id, cand_id, round(score, 9) AS score, rank::INTEGER AS rank FROM fused WHERE rank <= 50")
def rrf_fuse(spark, d):
    return fusion.rrf(_lists(spark, d), 10, top_n=50).select("ref_id", "cand_id", F.round("score", 9).alias("score"), "rank")


@query(with_(V.CHANNELS, "weighted AS (SELECT ref_id, cand_id, round(sum(CASE channel WHEN 'exact' THEN 2.0::DOUBLE ELSE 0.5 END / (20 + rank)), 12) AS score FROM lists WHERE channel <> 'char' GROUP BY ALL)") + "SELECT ref_id, cand_id, round(score, 9) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS rank FROM weighted) WHERE rank <= 20")
def rrf_weighted(spark, d):
    return fusion.rrf(_lists(spark, d), 20, {"exact": 2.0, "word": 0.5, "char": 0.0}, 20).select("ref_id", "cand_id", F.round("score", 9).alias("score"), "rank")


@query(with_(V.REC, V.EXACT, V.WORD, V.CHAR, "lists AS (SELECT ref_id, 'exact' AS channel, cand_id, rank FROM exact UNION ALL SELECT ref_id, 'word', cand_id, rank FROM word)", rrf_sql("10"), "more AS (SELECT ref_id, cand_id, rank FROM fused UNION ALL SELECT ref_id, cand_id, rank FROM chars)", rrf_sql("60", "more", "refused")) + "SELECT ref_id, cand_id, round(score, 9) AS score, rank::INTEGER AS rank FROM refused WHERE rank <= 50")
def rrf_extra(spark, d):
    return fusion.rrf_in_turn(_lists(spark, d), ["char"], 10, 60, 50).select("ref_id", "cand_id", F.round("score", 9).alias("score"), "rank")


@query(with_(V.CHANNELS, V.GT, "g AS (SELECT unnest([10.0, 20.0, 40.0, 60.0])::DOUBLE AS k)", "f AS (SELECT k, ref_id, cand_id, round(sum(1.0::DOUBLE / (k + rank)), 12) AS score FROM lists, g GROUP BY ALL)", "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, ref_id ORDER BY score DESC, cand_id) AS rank FROM f) WHERE rank <= 5)") + "SELECT k, (SELECT count(*) FROM h JOIN gt USING (ref_id, cand_id) WHERE h.k = g.k) AS hits, (SELECT count(*) FROM gt) AS pairs, round((SELECT count(*) FROM h JOIN gt USING (ref_id, cand_id) WHERE h.k = g.k) / (SELECT count(*) FROM gt), 6) AS recall FROM g")
def rrf_grid_recall(spark, d):
    return fusion.rrf_grid(_lists(spark, d), V.truth(spark, d), 5).select("k", "hits", "pairs", r6("recall", "recall"))


COARSE = """coarse AS (SELECT ref_id, cand_id, score, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, frank) AS rank FROM (
  SELECT f.ref_id, f.cand_id, f.rank AS frank, round(0.60::DOUBLE * f.score / max(f.score) OVER (PARTITION BY f.ref_id) + 0.25::DOUBLE * n / 3 + 0.15::DOUBLE * e, 9) AS score
  FROM fused f JOIN (SELECT ref_id, cand_id, count(DISTINCT channel) AS n, max(CASE channel WHEN 'exact' THEN 1 ELSE 0 END) AS e FROM lists GROUP BY ALL) a USING (ref_id, cand_id)))"""
CUT = "cut AS (SELECT * FROM (SELECT *, greatest(6, least(12, sum(CASE WHEN score >= 0.9::DOUBLE * peak THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id))) AS lim FROM (SELECT *, max(score) OVER (PARTITION BY ref_id) AS peak FROM coarse)) WHERE rank <= lim)"


def _coarse(spark, d):
    def build():
        every = _lists(spark, d)
        return fusion.coarse(fusion.rrf(every, 10), every, 3)

    return stored(spark, "coarse", [f"{d}/documents.parquet"], build)


@query(with_(V.CHANNELS, rrf_sql("10"), COARSE, CUT) + "SELECT ref_id, cand_id, round(score, 6) AS score, rank::INTEGER AS rank FROM cut")
def coarse_truncate(spark, d):
    return fusion.truncate(_coarse(spark, d)).select("ref_id", "cand_id", r6("score", "score"), "rank")


@query(with_(V.CHANNELS, V.GT, rrf_sql("10"), COARSE, "g AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS ratio)", "t AS (SELECT ratio, ref_id, cand_id, rank, greatest(6, least(12, sum(CASE WHEN score >= ratio * peak THEN 1 ELSE 0 END) OVER (PARTITION BY ratio, ref_id))) AS lim FROM (SELECT *, max(score) OVER (PARTITION BY ref_id) AS peak FROM coarse), g)") + "SELECT ratio, round(count(*) / count(DISTINCT ref_id), 6) AS avg_k, round(count(gt.ref_id) / (SELECT count(*) FROM gt), 6) AS recall, count(*) / count(DISTINCT ref_id) BETWEEN 5.5 AND 7.0 AS in_band FROM t LEFT JOIN gt USING (ref_id, cand_id) WHERE rank <= lim GROUP BY ratio")
def truncate_ratio_grid(spark, d):
    return fusion.ratio_grid(_coarse(spark, d), V.truth(spark, d)).select("ratio", r6("avg_k", "avg_k"), r6("recall", "recall"), "in_band")


@query(with_(V.CHANNELS, V.REFS, rrf_sql("10"), COARSE, CUT) + "SELECT kept, refs, pool, round(1 - kept / (refs * pool), 9) AS reduction_ratio FROM (SELECT (SELECT count(*) FROM cut) AS kept, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM rec WHERE src > 1) AS pool)")
def reduction_ratio(spark, d):
    return fusion.reduction_ratio(fusion.truncate(_coarse(spark, d)), V.references(spark, d), V.sides(spark, d)[1]).withColumn("reduction_ratio", F.round("reduction_ratio", 9))


# retrieval metrics

STATS = """SELECT {k} count(*) AS n_refs, sum(t)::BIGINT AS pairs, sum(h)::BIGINT AS hits, round(coalesce(sum(h) / nullif(sum(t), 0), 0), 6) AS micro_recall,
round(coalesce(count(*) FILTER (h > 0) / nullif(count(*) FILTER (t > 0), 0), 0), 6) AS any_hit_rate, round(sum(n) / count(*), 6) AS avg_cands,
round(coalesce(count(*) FILTER (t = 0 AND n > 0) / nullif(count(*) FILTER (t = 0), 0), 0), 6) AS singleton_rate FROM per {g}"""
PER = """per AS (SELECT c.channel, r.ref_id, r.bucket, (SELECT count(*) FROM g WHERE g.ref_id = r.ref_id) AS t, (SELECT count(*) FROM l WHERE l.channel = c.channel AND l.ref_id = r.ref_id) AS n,
  (SELECT count(*) FROM l JOIN g USING (ref_id, cand_id) WHERE l.channel = c.channel AND l.ref_id = r.ref_id) AS h FROM (SELECT DISTINCT channel FROM l) c, refs r)"""
PLAIN, MERGED = ("l AS (SELECT DISTINCT channel, ref_id, cand_id FROM lists)", "g AS (SELECT DISTINCT * FROM gt)"), ("l AS (SELECT DISTINCT 'union' AS channel, ref_id, cand_id FROM lists)", "g AS (SELECT DISTINCT * FROM gt)")


@query(with_(V.CHANNELS, V.GT, V.REFS, *PLAIN, PER) + STATS.format(k="channel,", g="GROUP BY channel"))
def channel_stats(spark, d):
    return _rounded(metrics.channel_stats(V.references(spark, d), V.truth(spark, d), _lists(spark, d)))


@query(with_(V.CHANNELS, V.GT, V.REFS, *MERGED, PER) + STATS.format(k="channel,", g="GROUP BY channel"))
def union_stats(spark, d):
    return _rounded(metrics.union_stats(V.references(spark, d), V.truth(spark, d), _lists(spark, d)))


@query(with_(V.CHANNELS, V.GT, V.REFS, *PLAIN, PER) + STATS.format(k="channel, bucket,", g="GROUP BY GROUPING SETS ((channel, bucket), (channel))"))
def stats_rollup(spark, d):
    return _rounded(metrics.channel_stats(V.references(spark, d), V.truth(spark, d), _lists(spark, d), by=["bucket"]))


@query(with_(V.CHANNELS, V.GT, rrf_sql("10")) + "SELECT n, (SELECT count(*) FROM fused JOIN (SELECT DISTINCT * FROM gt) USING (ref_id, cand_id) WHERE rank <= n) AS hits, (SELECT count(*) FROM (SELECT DISTINCT * FROM gt)) AS pairs, round((SELECT count(*) FROM fused JOIN (SELECT DISTINCT * FROM gt) USING (ref_id, cand_id) WHERE rank <= n) / (SELECT count(*) FROM (SELECT DISTINCT * FROM gt)), 6) AS recall FROM (SELECT unnest([1, 3, 5, 10, 20, 50]) AS n)")
def recall_at_n(spark, d):
    return _rounded(metrics.recall_at(fusion.rrf(_lists(spark, d), 10), V.truth(spark, d)))


@query(with_(V.CHANNELS, V.GT, rrf_sql("10")) + "SELECT count(*) AS n_refs, round(coalesce(avg(f), 0), 6) AS mean_first_hit_rank FROM (SELECT ref_id, min(rank) AS f FROM fused JOIN gt USING (ref_id, cand_id) GROUP BY ref_id)")
def first_hit_rank(spark, d):
    return _rounded(metrics.first_hit_rank(fusion.rrf(_lists(spark, d), 10, truth=V.truth(spark, d)), V.truth(spark, d)))


@query(with_(V.CHANNELS, V.GT, V.REFS, rrf_sql("10"), "g AS (SELECT DISTINCT * FROM gt)", "e AS (SELECT n, r.ref_id, (SELECT count(*) FROM g WHERE g.ref_id = r.ref_id) AS t, (SELECT count(*) FROM fused JOIN g USING (ref_id, cand_id) WHERE ref_id = r.ref_id AND rank <= n) AS h FROM refs r, (SELECT unnest([1, 3, 5, 10]) AS n))") + "SELECT n, round(avg(CASE WHEN t = 0 THEN 1.0 WHEN h = 0 THEN 0 ELSE 5.0 * h / (t + 4 * h) END), 6) AS oracle_f05 FROM e GROUP BY n")
def oracle_f05_at_k(spark, d):
    return _rounded(metrics.oracle_f05(V.references(spark, d), fusion.rrf(_lists(spark, d), 10), V.truth(spark, d)))


@query(with_(V.CHANNELS, V.GT, V.REFS, "g AS (SELECT unnest([10.0, 20.0, 40.0, 60.0])::DOUBLE AS k)", "f AS (SELECT k, ref_id, cand_id, round(sum(1.0::DOUBLE / (k + rank)), 12) AS score FROM lists, g GROUP BY ALL)", "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, ref_id ORDER BY score DESC, cand_id) AS rank FROM f) WHERE rank <= 5)",
             "per AS (SELECT bucket, k, count(*) AS hits FROM h JOIN (SELECT DISTINCT * FROM gt) USING (ref_id, cand_id) JOIN refs USING (ref_id) GROUP BY bucket, k)") + "SELECT bucket, coalesce(k, 10) AS k FROM (SELECT DISTINCT bucket FROM refs) LEFT JOIN (SELECT bucket, k FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY hits DESC, k) AS place FROM per) WHERE place = 1) USING (bucket)")
def rrf_k_by_bucket(spark, d):
    """The k that each bucket would be fused with."""
    best = fusion.tune_rrf(_lists(spark, d), V.truth(spark, d), V.references(spark, d), 5)
    return spark.createDataFrame(sorted(best.items()), "bucket string, k double")


@query(with_(V.REC, V.EXACT, V.GT, V.REFS, "a AS (SELECT 'all_empty' AS baseline, ref_id, NULL AS cand_id FROM refs WHERE false UNION ALL SELECT DISTINCT 'all_candidates', ref_id, cand_id FROM exact UNION ALL SELECT DISTINCT 'no_singleton_filter', ref_id, cand_id FROM gt UNION ALL SELECT 'no_singleton_filter', ref_id, min(cand_id) FROM exact WHERE ref_id NOT IN (SELECT ref_id FROM gt) GROUP BY ref_id)",
             "e AS (SELECT b.baseline, r.ref_id, (SELECT count(*) FROM (SELECT DISTINCT * FROM gt) g WHERE g.ref_id = r.ref_id) AS t, (SELECT count(*) FROM a WHERE a.baseline = b.baseline AND a.ref_id = r.ref_id) AS p, (SELECT count(*) FROM a JOIN (SELECT DISTINCT * FROM gt) g USING (ref_id, cand_id) WHERE a.baseline = b.baseline AND ref_id = r.ref_id) AS h FROM refs r, (SELECT unnest(['all_empty', 'all_candidates', 'no_singleton_filter']) AS baseline) b)") + "SELECT baseline, round(avg(CASE WHEN t = 0 AND p = 0 THEN 1.0 WHEN t = 0 OR p = 0 THEN 0.0 ELSE 5.0 * h / (t + 4 * p) END), 6) AS macro_f05 FROM e GROUP BY baseline")
def baselines(spark, d):
    return _rounded(metrics.baselines(V.references(spark, d), V.truth(spark, d), blocking.exact_channel(*V.sides(spark, d))))


# features


@query(r"SELECT term AS token, count(*) AS df, round(ln((n + 1) / (count(*) + 1)) + 1, 6) AS idf FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term, (SELECT count(*) FROM documents) AS n FROM documents) GROUP BY term, n")
def idf_table(spark, d):
    return _rounded(features.idf_table(V.records(spark, d), "toks"))


def _feature_pairs(spark, d):
    """Pairs of the exact channel, and their features."""
    rec = V.records(spark, d).withColumn("name_tokens", text.tokens(F.col("name_core"))).withColumn("addr_tokens", text.tokens(F.col("addr_norm")))
    empty = F.lit("")
    full = rec.select(
        "entity_id", "name_core", F.col("name_core").alias("name_norm"), "name_tokens", "addr_norm", "addr_tokens", "addr_postal", "addr_house_number", empty.alias("addr_state"), empty.alias("addr_city"),
        empty.alias("name_legal_suffix"), F.filter("addr_tokens", lambda t: t.rlike(r"^\p{Nd}+$")).alias("addr_digits"), F.array().cast("array<string>").alias("name_phonetic"), F.lit("latin").alias("script_type"),
        F.col("bucket").alias("country_norm"), (F.col("name_core") == "").alias("is_missing_name"), (F.col("addr_norm") == "").alias("is_missing_addr"),
    )
    full = features.with_weights(full, features.idf_table(full), full.count())
    lists_ = blocking.exact_channel(*V.sides(spark, d)).select("ref_id", "cand_id", (F.col("rank") - 1).alias("rank"))
    return features.features(lists_, full)


FEATURE_PAIRS = "fp AS (SELECT e.ref_id, e.cand_id, (e.rank - 1)::INTEGER AS rank, a.name_core AS na, b.name_core AS nb, a.addr_norm AS aa, b.addr_norm AS ab, string_split(a.addr_norm, ' ') AS ta, string_split(b.addr_norm, ' ') AS tb, a.addr_postal AS pa, b.addr_postal AS pb FROM exact e JOIN rec a ON a.entity_id = e.ref_id JOIN rec b ON b.entity_id = e.cand_id)"


@query(with_(V.REC, V.EXACT, FEATURE_PAIRS, r"""f AS (SELECT *, list_distinct(list_filter(ta, lambda t: t <> '')) AS da, list_distinct(list_filter(tb, lambda t: t <> '')) AS db,
  list_distinct(list_transform(range(1, greatest(len(aa) - 2, 1) + 1), lambda i: substr(aa, i, 3))) AS ga, list_distinct(list_transform(range(1, greatest(len(ab) - 2, 1) + 1), lambda i: substr(ab, i, 3))) AS gb FROM fp)""") + """
SELECT ref_id, cand_id, rank, round(CASE WHEN len(da) + len(db) = 0 THEN 0 ELSE len(list_intersect(da, db)) / len(list_distinct(list_concat(da, db))) END, 4) AS addr_token_jaccard,
  round(CASE WHEN aa = '' AND ab = '' THEN 0 WHEN aa = '' OR ab = '' THEN 0 ELSE len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) END, 4) AS addr_char3_jaccard,
  CASE WHEN pa <> '' AND pa = pb THEN 1.0 ELSE 0.0 END::DOUBLE AS addr_postal_exact, round(1 / (rank + 1), 4) AS ret_rank_inverse,
  round(CASE WHEN greatest(len(aa), len(ab)) = 0 THEN 0 ELSE least(len(aa), len(ab)) / greatest(len(aa), len(ab)) END, 4) AS struct_addr_len_ratio FROM f""")
def features_sets(spark, d):
    f = _feature_pairs(spark, d)
    four = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return f.select("ref_id", "cand_id", F.col("ret_candidate_rank").cast("int").alias("rank"), *map(four, ("addr_token_jaccard", "addr_char3_jaccard", "addr_postal_exact", "ret_rank_inverse", "struct_addr_len_ratio")))


@query(with_(V.REC, V.EXACT, FEATURE_PAIRS) + "SELECT ref_id, cand_id, CASE WHEN aa = '' OR ab = '' THEN 0 ELSE round(jaro_winkler_similarity(aa, ab), 4) END AS jaro_winkler, levenshtein(aa, ab)::INTEGER AS edits FROM (SELECT ref_id, cand_id, replace(strip_accents(aa), 'ß', 'ss') AS aa, replace(strip_accents(ab), 'ß', 'ss') AS ab FROM fp)")
def feature_jaro_winkler(spark, d):
    # without accents: the SQL functions count bytes
    rec = V.records(spark, d).select("entity_id", F.replace(arrow.without_accents(F.col("addr_norm")), F.lit("ß"), F.lit("ss")).alias("addr_norm"))
    p = blocking.exact_channel(*V.sides(spark, d)).select("ref_id", "cand_id").join(rec.select(F.col("entity_id").alias("ref_id"), F.col("addr_norm").alias("aa")), "ref_id").join(rec.select(F.col("entity_id").alias("cand_id"), F.col("addr_norm").alias("ab")), "cand_id")
    sims = arrow.string_similarities(F.col("aa"), F.col("ab"), F.lit(""), F.lit(""))
    return p.select("ref_id", "cand_id", F.round(sims["name_jaro_winkler"], 4).alias("jaro_winkler"), F.levenshtein("aa", "ab").alias("edits"))


@query()
def features_all(spark, d):
    """The features of sampled pairs of the fused candidates, with the signals of their retrieval."""
    return _sampled_features(spark, d)


# sampling

HASH = "((n % 1073741824) * 2654435761) % 4294967296"


def _key(c: str):
    return pairs.spread(F.regexp_extract(c, r"(\d+)$", 1).cast("long"))


@query(with_(V.REFS) + f"SELECT ref_id, CASE WHEN row_number() OVER (ORDER BY {HASH}, ref_id) <= floor((SELECT count(*) FROM refs) * 0.2) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, doc_id AS n FROM refs)")
def train_val_split(spark, d):
    return pairs.split(V.references(spark, d), 0.2, _key("ref_id")).select("ref_id", "split")


@query(with_(V.REFS) + f"SELECT ref_id, (({HASH}) % 5)::INTEGER AS fold FROM (SELECT *, doc_id AS n FROM refs)")
def grouped_folds(spark, d):
    return pairs.folds(V.references(spark, d), 5, _key("ref_id")).select("ref_id", "fold")


@query(with_(V.REFS) + f"SELECT ref_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {HASH}, ref_id) AS place FROM (SELECT *, doc_id AS n FROM refs)) WHERE place <= 20")
def sample_references(spark, d):
    return pairs.sample_references(V.references(spark, d), 20, _key("ref_id")).select("ref_id", "bucket")


def _sampled(spark, d):
    refs = V.references(spark, d).select("ref_id", "bucket")
    pool = pairs.easy_pool(V.sides(spark, d)[1].select(F.col("id").alias("cand_id"), "bucket"), key=_key("cand_id"))
    return pairs.sample_pairs(refs, fusion.rrf(_lists(spark, d), 10, top_n=50, truth=V.truth(spark, d)), V.truth(spark, d), pool, _key("ref_id"))


def _sampled_features(spark, d):
    """Features of sampled pairs on normalised records, made once in a session. The tables hold no vectors of records, so dense_score stays 0."""
    def build():
        raw = V.records(spark, d).select("entity_id", F.col("name_core").alias("business_name"), F.col("addr_norm").alias("business_address"), F.col("bucket").alias("country"))
        numbers = V.records(spark, d).select("entity_id", "addr_postal", "addr_house_number")
        full = written(normalise.normalise(raw).drop("addr_postal", "addr_house_number").join(numbers, "entity_id"), "normalised")
        full = written(features.with_weights(full, features.idf_table(full), full.count()), "weighed")
        found = fusion.signals(_lists(spark, d), 10, 3)
        sounds = blocking.phonetic_channel(*(blocking.phonetic_columns(x, "name_core", "addr_norm") for x in V.sides(spark, d))).select("ref_id", "cand_id", F.col("score").alias("phon_score"))
        rows = written(_sampled(spark, d), "sampled")
        for signal in (found, sounds):
            rows = rows.join(signal, ["ref_id", "cand_id"], "left")
        return features.features(rows, full)

    return stored(spark, "sampled-features", [f"{d}/documents.parquet"], build)


SAMPLE = ("fl AS (SELECT * FROM fused WHERE rank <= 50)", "g AS (SELECT DISTINCT * FROM gt)", "m AS (SELECT fl.*, CASE WHEN g.ref_id IS NULL THEN 0 ELSE 1 END AS label FROM fl LEFT JOIN g USING (ref_id, cand_id))",
          "c AS (SELECT r.ref_id, r.bucket, coalesce((SELECT sum(label) FROM m WHERE m.ref_id = r.ref_id), 0) AS np, (SELECT count(*) FROM g WHERE g.ref_id = r.ref_id) AS nt FROM refs r)",
          "o AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank, cand_id) AS place FROM m WHERE label = 0)")


@query(with_(V.CHANNELS, V.GT, V.REFS, rrf_sql("10"), *SAMPLE) + "SELECT ref_id, cand_id, 1 AS label, 'pos' AS neg_type, (rank - 1)::INTEGER AS rank FROM m WHERE label = 1 UNION ALL SELECT ref_id, cand_id, 0, 'hard', (rank - 1)::INTEGER FROM o JOIN c USING (ref_id) WHERE place <= CASE WHEN nt = 0 THEN 3 ELSE 3 * np END")
def pair_sampling(spark, d):
    return _sampled(spark, d).where("neg_type != 'easy'").select("ref_id", "cand_id", "label", "neg_type", "rank")


POOL = ("p AS (SELECT cand_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY h, cand_id) - 1 AS slot, count(*) OVER (PARTITION BY bucket) AS size FROM (SELECT entity_id AS cand_id, bucket, ((doc_id % 1073741824) * 2654435761) % 4294967296 AS h FROM rec WHERE src > 1))",
        "w AS (SELECT c.ref_id, c.bucket, CASE WHEN nt = 0 THEN 2 ELSE 2 * np END AS want, ((doc_id % 1073741824) * 2654435761) % 4294967296 AS h FROM c JOIN refs USING (ref_id))",
        "z AS (SELECT DISTINCT bucket, size FROM p)", "t AS (SELECT ref_id, bucket, want, j, (h + j) % size AS slot FROM (SELECT w.*, size, unnest(range(0, least(want * 8, size)::BIGINT)) AS j FROM w JOIN z USING (bucket) WHERE want > 0))",
        "fr AS (SELECT ref_id, cand_id, want, j FROM t JOIN p USING (bucket, slot) WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.ref_id = t.ref_id AND fl.cand_id = p.cand_id) AND NOT EXISTS (SELECT 1 FROM g WHERE g.ref_id = t.ref_id AND g.cand_id = p.cand_id))")


@query(with_(V.CHANNELS, V.GT, V.REFS, rrf_sql("10"), *SAMPLE, *POOL) + "SELECT ref_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY j) AS place FROM fr) WHERE place <= want")
def easy_negatives(spark, d):
    return _sampled(spark, d).where("neg_type = 'easy'").select("ref_id", "cand_id")


@query(with_(V.CHANNELS, V.GT, V.REFS, rrf_sql("10"), *SAMPLE, *POOL) + "SELECT neg_type, count(*) AS n_pairs, count(DISTINCT ref_id) AS n_refs FROM (SELECT ref_id, 'pos' AS neg_type FROM m WHERE label = 1 UNION ALL SELECT ref_id, 'easy' FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY j) AS place FROM fr) WHERE place <= want) GROUP BY neg_type")
def pair_variant_without_hard(spark, d):
    return pairs.summary(pairs.without_hard(_sampled(spark, d))).drop("n_positive")


# decisions


def _scored(spark, d):
    return linkage.scored_pairs(spark, d)


def _refs(spark, d):
    """References of two labelled buckets, one open one and the rest."""
    return V.references(spark, d).select("ref_id", "bucket").withColumn("is_open", F.col("bucket").isin("fr"))


PEAK = "pk AS (SELECT p.*, r.bucket, r.bucket = 'fr' AS is_open, max(prob) OVER (PARTITION BY ref_id) AS peak FROM probs p JOIN refs r USING (ref_id))"
V1 = "NOT (peak < {s} + CASE WHEN is_open THEN {b} ELSE 0 END OR (is_open AND peak < {v})) AND prob >= greatest({m}, peak - 0.05::DOUBLE)"
DECIDED = "pred AS (SELECT ref_id, cand_id, prob FROM pk WHERE " + V1.format(s="0.3::DOUBLE", b="0.1::DOUBLE", v="0.5::DOUBLE", m="0.5::DOUBLE") + ")"


@query(with_(V.SCORED, PEAK, DECIDED) + "SELECT * FROM pred")
def decision_v1(spark, d):
    return decision.decide(_scored(spark, d), _refs(spark, d))


F05 = "CASE WHEN t = 0 AND p = 0 THEN 1.0 WHEN t = 0 OR p = 0 THEN 0.0 ELSE 5.0 * h / (t + 4 * p) END"


def grid_sql(params: str, keep: str, keys: str) -> str:
    return f"""par AS ({params}), g AS (SELECT DISTINCT * FROM gt), kept AS (SELECT {keys}, ref_id, cand_id FROM pk, par WHERE {keep}),
hp AS (SELECT {keys}, k.ref_id, count(*) AS p, count(g.cand_id) AS h FROM kept k LEFT JOIN g ON g.ref_id = k.ref_id AND g.cand_id = k.cand_id GROUP BY {keys}, k.ref_id),
tt AS (SELECT ref_id, count(*) AS t FROM g GROUP BY ref_id)
SELECT {keys}, round(avg({F05}), 6) AS macro_f05 FROM (SELECT {keys}, r.ref_id, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(h, 0) AS h FROM refs r CROSS JOIN par LEFT JOIN tt USING (ref_id) LEFT JOIN hp USING ({keys}, ref_id)) GROUP BY {keys}"""


@query(with_(V.SCORED, PEAK, grid_sql("SELECT a::DOUBLE AS tau_match, b::DOUBLE AS tau_s FROM (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS a), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) AS b)", "peak >= tau_s AND prob >= greatest(tau_match, peak - 0.05::DOUBLE)", "tau_match, tau_s")))
def decision_v1_grid(spark, d):
    return _rounded(decision.decide_grid(_scored(spark, d), _refs(spark, d), V.truth(spark, d)))


V2 = ("q AS (SELECT *, row_number() OVER o AS k, sum(prob) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(prob) OVER (PARTITION BY ref_id) / 0.85::DOUBLE AS tot, round(product(1 - prob) OVER (PARTITION BY ref_id), 12) AS e_none FROM pk WINDOW o AS (PARTITION BY ref_id ORDER BY prob DESC, cand_id))",
      "e AS (SELECT *, round(1.25::DOUBLE * (run / k) * r / (0.25::DOUBLE * (run / k) + r + 1e-12::DOUBLE), 12) AS e_f FROM (SELECT *, CASE WHEN tot > 0 THEN run / tot ELSE 0 END AS r FROM q))",
      "b AS (SELECT *, min(CASE WHEN e_f = top_f THEN k END) OVER (PARTITION BY ref_id) AS cut FROM (SELECT *, max(e_f) OVER (PARTITION BY ref_id) AS top_f FROM e))")


@query(with_(V.SCORED, PEAK, *V2) + "SELECT ref_id, cand_id, prob FROM b WHERE top_f > e_none AND k <= cut AND prob >= 0.5 AND NOT (is_open AND peak < 0.5)")
def decision_v2(spark, d):
    return decision.decide_expected(_scored(spark, d), _refs(spark, d))


HATS = "unnest([0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 1.0])::DOUBLE"
V2_GRID = (f"hq AS (SELECT pk.ref_id, cand_id, prob, recall_hat FROM pk, (SELECT {HATS} AS recall_hat))",
           "q AS (SELECT *, row_number() OVER o AS k, sum(prob) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(prob) OVER (PARTITION BY recall_hat, ref_id) / recall_hat AS tot, round(product(1 - prob) OVER (PARTITION BY recall_hat, ref_id), 12) AS e_none FROM hq WINDOW o AS (PARTITION BY recall_hat, ref_id ORDER BY prob DESC, cand_id))",
           "e AS (SELECT *, round(1.25::DOUBLE * (run / k) * r / (0.25::DOUBLE * (run / k) + r + 1e-12::DOUBLE), 12) AS e_f FROM (SELECT *, CASE WHEN tot > 0 THEN run / tot ELSE 0 END AS r FROM q))",
           "b AS (SELECT *, min(CASE WHEN e_f = top_f THEN k END) OVER (PARTITION BY recall_hat, ref_id) AS cut FROM (SELECT *, max(e_f) OVER (PARTITION BY recall_hat, ref_id) AS top_f FROM e))",
           "fl AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS tau_floor)", f"par AS (SELECT recall_hat, tau_floor FROM (SELECT {HATS} AS recall_hat), fl)", "g AS (SELECT DISTINCT * FROM gt)",
           "hp AS (SELECT recall_hat, tau_floor, b.ref_id, count(*) AS p, count(g.cand_id) AS h FROM (SELECT * FROM b, fl WHERE top_f > e_none AND k <= cut AND prob >= tau_floor) b LEFT JOIN g ON g.ref_id = b.ref_id AND g.cand_id = b.cand_id GROUP BY recall_hat, tau_floor, b.ref_id)",
           "tt AS (SELECT ref_id, count(*) AS t FROM g GROUP BY ref_id)")
V2_MACRO = f"SELECT recall_hat, tau_floor, round(avg({F05}), 6) AS macro_f05 FROM (SELECT recall_hat, tau_floor, r.ref_id, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(h, 0) AS h FROM refs r CROSS JOIN par LEFT JOIN tt USING (ref_id) LEFT JOIN hp USING (recall_hat, tau_floor, ref_id)) GROUP BY recall_hat, tau_floor"


@query(with_(V.SCORED, PEAK, *V2_GRID) + V2_MACRO)
def decision_v2_grid(spark, d):
    return _rounded(decision.expected_grid(_scored(spark, d), _refs(spark, d), V.truth(spark, d)))


@query(with_(V.SCORED, PEAK, grid_sql("SELECT a::DOUBLE AS boost, b::DOUBLE AS veto FROM (SELECT unnest([0.0, 0.1, 0.2]) AS a), (SELECT unnest([0.0, 0.3, 0.5, 0.6, 0.7]) AS b)", "NOT (peak < 0.3::DOUBLE + boost OR peak < veto) AND prob >= greatest(0.5::DOUBLE, peak - 0.05::DOUBLE)", "boost, veto")))
def open_set_grid(spark, d):
    return _rounded(decision.open_set_grid(_scored(spark, d), _refs(spark, d), V.truth(spark, d)))


@query(with_(V.SCORED, PEAK) + "SELECT ref_id, is_open, peak, peak < 0.3::DOUBLE + CASE WHEN is_open THEN 0.1::DOUBLE ELSE 0 END OR (is_open AND peak < 0.5::DOUBLE) AS refused FROM (SELECT DISTINCT ref_id, is_open, peak FROM pk)")
def open_set_veto(spark, d):
    tops = decision.top_scores(_scored(spark, d), _refs(spark, d)).withColumn("is_open", F.col("bucket") == "fr")
    return tops.select("ref_id", "is_open", "peak", ((F.col("peak") < F.lit(0.3) + F.when(F.col("is_open"), 0.1).otherwise(0.0)) | (F.col("is_open") & (F.col("peak") < 0.5))).alias("refused"))


@query(with_(V.SCORED, PEAK) + "SELECT threshold, count(*) AS n, sum(CASE WHEN peak < threshold THEN 1 ELSE 0 END)::BIGINT AS vetoed, round(sum(CASE WHEN peak < threshold THEN 1 ELSE 0 END) / count(*), 6) AS share FROM (SELECT DISTINCT ref_id, peak FROM pk), (SELECT unnest([0.0, 0.3, 0.5, 0.7, 0.9, 0.95])::DOUBLE AS threshold) GROUP BY threshold")
def veto_impact(spark, d):
    return _rounded(decision.veto_impact(decision.top_scores(_scored(spark, d), _refs(spark, d))))


@query(with_(V.SCORED, PEAK) + "SELECT bucket, count(*) AS n, " + ", ".join(f"round(quantile_cont(peak, {q}), 6) AS q{round(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM (SELECT DISTINCT ref_id, bucket, peak FROM pk) GROUP BY bucket")
def score_quantiles(spark, d):
    return _rounded(decision.score_quantiles(decision.top_scores(_scored(spark, d), _refs(spark, d))))


# evaluation

EVAL = "ev AS (SELECT r.ref_id, r.bucket, (SELECT count(*) FROM (SELECT DISTINCT * FROM gt) g WHERE g.ref_id = r.ref_id) AS t, (SELECT count(*) FROM pred WHERE pred.ref_id = r.ref_id) AS p, (SELECT count(*) FROM pred JOIN (SELECT DISTINCT * FROM gt) g USING (ref_id, cand_id) WHERE ref_id = r.ref_id) AS h FROM refs r)"
NAMES = "pred AS (SELECT DISTINCT ref_id, cand_id FROM exact)"
MACRO = f"SELECT count(*) AS n_refs, round(avg(f), 6) AS macro_f05, round(coalesce(avg(f) FILTER (t = 0), 0), 6) AS singleton_f05, round(coalesce(avg(f) FILTER (t > 0), 0), 6) AS match_f05, count(*) FILTER (t = 0) AS n_singletons FROM (SELECT *, {F05} AS f FROM ev)"


@query(with_(V.REC, V.EXACT, V.REFS, V.GT, NAMES, EVAL) + MACRO)
def macro_f05(spark, d):
    return _rounded(metrics.macro_f05(V.references(spark, d), V.truth(spark, d), blocking.exact_channel(*V.sides(spark, d))))


@query(with_(V.SCORED, PEAK, DECIDED, EVAL) + MACRO)
def linkage_macro_f05(spark, d):
    return _rounded(metrics.macro_f05(V.references(spark, d), V.truth(spark, d), decision.decide(_scored(spark, d), _refs(spark, d))))


CLASS = "CASE WHEN t = 0 AND p = 0 THEN 'true_singleton' WHEN t = 0 THEN 'false_positive' WHEN p = 0 THEN 'miss' WHEN t = p AND p = h THEN 'exact' ELSE 'partial' END"


@query(with_(V.SCORED, PEAK, DECIDED, EVAL) + f"SELECT ref_id, t AS n_true, p AS n_pred, h AS n_hit, {CLASS} AS error_class, round({F05}, 6) AS f05 FROM ev")
def error_classes(spark, d):
    rows = audit.error_classes(V.references(spark, d), V.truth(spark, d), decision.decide(_scored(spark, d), _refs(spark, d)))
    return rows.select("ref_id", "n_true", "n_pred", "n_hit", "error_class", r6("f05", "f05"))


@query(with_(V.SCORED, PEAK, DECIDED, EVAL) + f"SELECT bucket AS \"group\", count(*) AS n, round(avg({F05}), 6) AS macro_f05, " + ", ".join(f"count(*) FILTER (c = '{k}') AS {k}" for k in ("true_singleton", "false_positive", "miss", "exact", "partial")) + f" FROM (SELECT *, {CLASS} AS c FROM ev) GROUP BY bucket")
def group_diagnostics(spark, d):
    rows = audit.error_classes(V.references(spark, d), V.truth(spark, d), decision.decide(_scored(spark, d), _refs(spark, d))).join(V.references(spark, d).select("ref_id", "bucket"), "ref_id")
    return audit.group_metrics(rows, "bucket").select("group", "n", r6("macro_f05", "macro_f05"), "true_singleton", "false_positive", "miss", "exact", "partial")


LABELLED = "lb AS (SELECT p.prob, CASE WHEN g.ref_id IS NULL THEN 0 ELSE 1 END AS label FROM probs p LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (ref_id, cand_id))"


def _labelled(spark, d):
    return _scored(spark, d).join(V.truth(spark, d).distinct().withColumn("hit", F.lit(1)), ["ref_id", "cand_id"], "left").select("ref_id", "cand_id", "prob", F.coalesce("hit", F.lit(0)).alias("label"))


@query(with_(V.SCORED, LABELLED) + "SELECT count(*) AS n, round(avg((prob - label) ** 2), 6) AS brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) AS log_loss FROM (SELECT *, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, prob)) AS q FROM lb)")
def brier_logloss(spark, d):
    return _rounded(metrics.brier_and_log_loss(_labelled(spark, d)))


@query(with_(V.SCORED, LABELLED) + "SELECT least(14, floor(prob * 15))::INTEGER AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(label), 6) AS positive_rate FROM lb GROUP BY 1")
def ece_bins(spark, d):
    return _rounded(metrics.reliability(_labelled(spark, d)))


@query(with_(V.SCORED, LABELLED) + "SELECT sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc FROM (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS rk FROM lb)")
def auc_rank_sum(spark, d):
    return _rounded(metrics.auc(_labelled(spark, d)))


KNOTS = [(0.1, 0.0), (0.3, 0.1), (0.6, 0.5), (0.9, 0.95)]


@query(with_(V.SCORED) + "SELECT ref_id, cand_id, round(CASE WHEN prob <= 0.1 THEN 0.0 WHEN prob < 0.3 THEN (prob - 0.1) * 0.5 WHEN prob < 0.6 THEN 0.1 + (prob - 0.3) * 4 / 3 WHEN prob < 0.9 THEN 0.5 + (prob - 0.6) * 1.5 ELSE 0.95 END, 9) AS calibrated FROM probs")
def isotonic_apply(spark, d):
    return _scored(spark, d).select("ref_id", "cand_id", F.round(models.apply_knots(F.col("prob"), KNOTS), 9).alias("calibrated"))


ISOTONIC = ("d AS (SELECT prob, count(*) AS w, sum(label) AS s FROM lb GROUP BY prob)", "o AS (SELECT *, row_number() OVER (ORDER BY prob) AS i, sum(s) OVER (ORDER BY prob) AS cs, sum(w) OVER (ORDER BY prob) AS cw FROM d)",
            "ij AS (SELECT a.i, b.i AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM o a JOIN o b ON b.i >= a.i)", "mn AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS low FROM ij)", "fit AS (SELECT j, max(low) AS y FROM mn GROUP BY j)")


@query(with_(V.SCORED, LABELLED, *ISOTONIC) + "SELECT prob, round(y, 6) AS fitted FROM fit JOIN o ON o.i = fit.j")
def isotonic_fit(spark, d):
    """The fitted probability at every score; the SQL has it as the largest of the smallest means about a score."""
    rows = models.by_score(_labelled(spark, d)).persist()
    points = models.knots(models.fit_isotonic(rows, counted=True))
    return rows.select("prob", F.round(models.apply_knots_joined(F.col("prob"), points), 6).alias("fitted"))


@query()
def model_scores(spark, d):
    """Out-of-fold probabilities of a boosted model on the features of sampled pairs."""
    scored, _ = models.out_of_fold(_sampled_features(spark, d))
    return scored.select("ref_id", "cand_id", "label", r6("oof_prob", "oof_prob"))


# guards, leaks and sinks


@query(with_(V.REC, V.REFS, V.EXACT) + "SELECT bucket, count(*) AS expected, count(e.ref_id) AS found, count(*) - count(e.ref_id) AS missing, round(count(e.ref_id) / count(*), 6) AS share FROM refs r LEFT JOIN (SELECT DISTINCT ref_id FROM exact) e USING (ref_id) GROUP BY bucket")
def coverage_check(spark, d):
    return _rounded(audit.coverage(V.references(spark, d), blocking.exact_channel(*V.sides(spark, d))))


@query(with_(V.REC, V.REFS, V.EXACT) + "SELECT bucket, count(*) AS missing FROM refs WHERE ref_id NOT IN (SELECT ref_id FROM exact) GROUP BY bucket")
def missing_references(spark, d):
    return audit.missing_references(V.references(spark, d), blocking.exact_channel(*V.sides(spark, d)))


@query(with_(V.REC, V.GT, V.WORD) + "SELECT DISTINCT ref_id, cand_id FROM gt WHERE NOT EXISTS (SELECT 1 FROM word w WHERE w.ref_id = gt.ref_id AND w.cand_id = gt.cand_id AND w.rank = 1)")
def missed_pairs(spark, d):
    return audit.missed_pairs(V.truth(spark, d), blocking.word_channel(*V.sides(spark, d), k=1))


@query(with_(V.REC) + "SELECT count(*) AS pairs, count(DISTINCT a.name_core) AS keys FROM rec a JOIN rec b USING (name_core) WHERE a.src = 1 AND b.src <> 1")
def leak_name_twin(spark, d):
    return audit.name_twins(V.records(spark, d), ["name_core"])


@query(with_(V.REC) + "SELECT count(*) AS shared FROM (SELECT name_core, addr_norm FROM rec WHERE src = 2 INTERSECT SELECT name_core, addr_norm FROM rec WHERE src = 3)")
def leak_overlap(spark, d):
    rec = V.records(spark, d)
    return audit.overlap(rec.where("src = 2"), rec.where("src = 3"), ["name_core", "addr_norm"])


@query(with_(V.REC, V.GT) + "SELECT b.doc_id - a.doc_id AS \"offset\", count(*) AS n FROM (SELECT DISTINCT * FROM gt) g JOIN rec a ON a.entity_id = ref_id JOIN rec b ON b.entity_id = cand_id GROUP BY 1")
def id_arithmetic(spark, d):
    return audit.id_offsets(V.truth(spark, d))


@query(with_(V.REC, V.GT, V.REFS) + "SELECT r.ref_id AS source1_entity_id, coalesce(string_agg(g.cand_id, ',' ORDER BY g.cand_id), '') AS matched_entity_ids FROM refs r LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (ref_id) GROUP BY r.ref_id")
def id_list_format(spark, d):
    return sinks.id_lists(V.references(spark, d), V.truth(spark, d))



from kinweave.plans import catalog_rules, catalog_tables  # noqa: E402, F401  they register their queries
