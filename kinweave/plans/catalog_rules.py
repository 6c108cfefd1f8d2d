"""Further queries of linkage: caps, extra channels, all features, tuning, diagnostics, guards and a whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.functions import lists, text
from kinweave.operators import audit, blocking, decision, dense, features, fusion, metrics, models, normalise, pairs
from kinweave.plans import catalog as C
from kinweave.plans import linkage, views
from kinweave.plans.catalog_tables import NORMAL
from kinweave.plans.registry import query, r6, rounded, with_
from kinweave.sources import folders, sinks

V = views
LOW_CAPS = Settings(exact_posting_cap=3, address_posting_cap=2, max_posting_scan=40)

# caps that bite, stand-ins for phonetic codes, further channels


@query(with_(V.REC, V.EXACT.replace("place <= 2000", "place <= 2")) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM exact")
def block_exact_capped(spark, d):
    """Two postings of each key at most: many keys have more."""
    return blocking.exact_channel(*V.sides(spark, d), cap=2)


@query(with_(V.REC, V.WORD.split(",word_held")[0] + "," + V.sparse_sql("word", "word_terms", scan=4)) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM word")
def block_word_capped(spark, d):
    """Four postings of each term are scanned: most terms have more."""
    return blocking.word_channel(*V.sides(spark, d), Settings(max_posting_scan=4))


@query(with_(V.REC.replace("lang AS bucket", "CASE WHEN doc_id % 50 < 2 THEN 'few' || lang ELSE lang END AS bucket"), "word_terms AS (SELECT entity_id, src, seq, bucket, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM rec)", V.sparse_sql("word", "word_terms", small_pool=50)) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM word")
def block_small_buckets(spark, d):
    """Small buckets beside large ones: in those with fewer than 50 candidates every term counts."""
    bucket = F.when(F.col("doc_id") % 50 < 2, F.concat(F.lit("few"), "bucket")).otherwise(F.col("bucket"))
    refs, cands = (V.words(x.withColumn("bucket", bucket)) for x in V.sides(spark, d))
    return blocking.sparse_channel(refs, cands, small_pool=50)


CODED = "ph_rec AS (SELECT *, array_to_string(list_transform(string_split(name_core, ' '), lambda t: t[1:3]), ' ') AS ph, array_to_string(list_transform(string_split(addr_norm, ' '), lambda t: t[1:3]), ' ') AS addr_ph FROM rec)"
KINDS = (("4.0", "core_addr", "name_core", "addr_ph"), ("3.0", "core_postal", "name_core", "addr_postal"), ("3.0", "core", "name_core", ""), ("2.5", "ph_addr", "ph", "addr_ph"), ("2.0", "ph_postal", "ph", "addr_postal"), ("2.0", "ph", "ph", ""))
PH_KEYS = "ph_keys AS (" + " UNION ALL ".join(f"SELECT entity_id, src, seq, bucket, {s} AS score, '{k}' AS kind, {a}{f' || chr(124) || {b}' if b else ''} AS key FROM ph_rec WHERE {a} <> ''{f' AND {b} <> chr(32)[2:]' if b else ''}" for s, k, a, b in KINDS) + " UNION ALL SELECT entity_id, src, seq, bucket, 1.5, 'addr', addr_ph FROM ph_rec WHERE len(string_split(addr_ph, ' ')) >= 2)"
PH_TERMS = "ph_terms AS (SELECT entity_id, src, seq, bucket, unnest(list_concat(list_transform(list_filter(string_split(ph, ' '), lambda t: t <> ''), lambda t: 'M_' || t), list_transform(list_filter(string_split(addr_ph, ' '), lambda t: t <> ''), lambda t: 'AM_' || t))) AS term FROM ph_rec)"
PH_TIERS = "ph_index AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, kind, key ORDER BY seq) AS place FROM ph_keys WHERE src > 1) WHERE place <= CASE kind WHEN 'addr' THEN 2 ELSE 3 END), ph_met AS (SELECT r.entity_id AS ref_id, c.entity_id AS cand_id, r.score::DOUBLE AS score FROM ph_keys r JOIN ph_index c USING (bucket, kind, key) WHERE r.src = 1 UNION ALL SELECT ref_id, cand_id, score FROM ph)"


def _coded(df):
    def codes(c: str):
        return F.array_join(F.transform(text.tokens(F.col(c)), lambda t: F.substring(t, 1, 3)), " ")

    def marked(c: str, mark: str):
        return F.transform(text.tokens(F.col(c)), lambda t: F.concat(F.lit(mark), t))

    df = df.withColumns({"core": F.col("name_core"), "ph": codes("name_core"), "addr_ph": codes("addr_norm")})
    return df.withColumn("terms", F.concat(marked("ph", "M_"), marked("addr_ph", "AM_")))


@query(with_(V.REC, CODED, PH_KEYS, PH_TERMS, V.sparse_sql("ph", "ph_terms", 16, 2, 0.03, 40, 50), PH_TIERS) + "SELECT ref_id, cand_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS rank FROM (SELECT ref_id, cand_id, max(score) AS score FROM ph_met GROUP BY ALL)) WHERE rank <= 50")
def block_phonetic_tiers(spark, d):
    """The seven tiers and the coded index with caps that bite; first letters stand for phonetic codes."""
    refs, cands = map(_coded, V.sides(spark, d))
    return blocking.phonetic_channel(refs, cands, s=LOW_CAPS).select("ref_id", "cand_id", r6("score", "score"), "rank")


EXTRA = ("aw_terms AS (SELECT entity_id, src, seq, bucket, unnest(regexp_extract_all(lower(addr_norm), '[\\p{L}\\p{N}_]{2,}')) AS term FROM rec)", "ac_words AS (SELECT entity_id, src, seq, bucket, ' ' || unnest(string_split(addr_norm, ' ')) || ' ' AS p FROM rec)",
         "ac_terms AS (SELECT entity_id, src, seq, bucket, substr(p, i, n) AS term FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM ac_words, (VALUES (3), (4), (5)) g(n) WHERE len(p) >= n AND p <> '  '))", "nc_terms AS (SELECT entity_id, src, seq, bucket, unnest(list_transform(list_filter(string_split(name_core, ' '), lambda t: t <> ''), lambda t: t[1:3])) AS term FROM rec)",
         *(V.sparse_sql(n, f"{n}_terms", 25, scan=50_000) for n in ("aw", "ac", "nc")))


@query(with_(V.REC, *EXTRA) + "SELECT 'addr_word' AS channel, ref_id, cand_id, score, rank::INTEGER AS rank FROM aw UNION ALL SELECT 'addr_char', ref_id, cand_id, score, rank::INTEGER FROM ac UNION ALL SELECT 'name_codes', ref_id, cand_id, score, rank::INTEGER FROM nc")
def block_extra_channels(spark, d):
    codes = F.transform(text.tokens(F.col("name_core")), lambda t: F.substring(t, 1, 3))
    refs, cands = (x.withColumn("codes", codes) for x in V.sides(spark, d))
    return blocking.extra_channels(refs, cands).select("channel", "ref_id", "cand_id", "score", "rank")


DENSE = "dn AS (SELECT ref_id, cand_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, seq) AS rank FROM (SELECT a.vec_id AS r, 'V-' || a.vec_id AS ref_id, 'V-' || b.vec_id AS cand_id, b.vec_id AS seq, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)) WHERE rank <= 50)"
DENSE_TRUTH = "dt AS (SELECT 'V-' || a.vec_id AS ref_id, 'V-' || b.vec_id AS cand_id FROM embeddings a JOIN embeddings b ON a.vec_id // 30 = b.vec_id // 30 WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)"


@query(with_(DENSE, DENSE_TRUTH, "ot AS (SELECT ref_id, cand_id FROM dt WHERE substr(cand_id, 3)::BIGINT = substr(ref_id, 3)::BIGINT + 1)", "un AS (SELECT count(*) AS m FROM (SELECT ref_id, cand_id FROM dn UNION SELECT * FROM ot) JOIN dt USING (ref_id, cand_id))",
             "c AS (SELECT unnest([1, 5, 10, 50]) AS n)", "per AS (SELECT n, r.ref_id, (SELECT count(*) FROM dt WHERE dt.ref_id = r.ref_id) AS t, (SELECT count(*) FROM dn JOIN dt USING (ref_id, cand_id) WHERE dn.ref_id = r.ref_id AND dn.rank <= n) AS h FROM c, (SELECT 'V-' || vec_id AS ref_id FROM embeddings WHERE vec_id % 3 = 0) r)")
       + "SELECT n, round(sum(h) / sum(t), 6) AS recall, round(avg(CASE WHEN t = 0 THEN 1.0 WHEN h = 0 THEN 0 ELSE 5.0 * h / (t + 4 * h) END), 6) AS oracle_f05, round((SELECT m FROM un) / (SELECT count(*) FROM dt), 6) AS union_recall FROM per GROUP BY n")
def dense_evaluation(spark, d):
    refs, cands = V.vectors(spark, d)
    block = (F.col("vec_id") / 30).cast("long").alias("block")
    truth = refs.select(F.col("id").alias("ref_id"), block, F.col("vec_id").alias("a")).join(cands.select(F.col("id").alias("cand_id"), block, F.col("vec_id").alias("b")), "block")
    return rounded(dense.evaluate(refs.select(F.col("id").alias("ref_id")), truth, dense.exact_knn(refs, cands), truth.where("b = a + 1")))


@query()
def block_dense_compressed(spark, d):
    return dense.compressed_knn(*V.vectors(spark, d), k=10)


# fusion


SWEEP = [{"exact": 2.0, "word": 1.0, "char": 1.0}, {"exact": 1.0, "word": 0.5, "char": 0.0}, {"exact": 0.0, "word": 1.0, "char": 1.0}]


@query(with_(V.CHANNELS, V.GT, "g AS (SELECT DISTINCT * FROM gt)") + " UNION ALL ".join(
    f"SELECT {i} AS setting, round((SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS rank FROM (SELECT ref_id, cand_id, round(sum({c} / (60 + rank)), 12) AS score FROM (SELECT *, CASE channel WHEN 'exact' THEN {w['exact']}::DOUBLE WHEN 'word' THEN {w['word']} ELSE {w['char']} END AS {c} FROM lists) WHERE {c} <> 0 GROUP BY ALL)) JOIN g USING (ref_id, cand_id) WHERE rank <= 3) / (SELECT count(*) FROM g), 6) AS recall"
    for i, w in enumerate(SWEEP) for c in ("v",)))
def weight_sweep(spark, d):
    found = fusion.weight_sweep(linkage.stored_lists(spark, d), V.truth(spark, d), SWEEP, 3)
    return rounded(spark.createDataFrame([(SWEEP.index(w), r) for w, r in found], "setting int, recall double"))


def _fused(spark, d):
    return fusion.rrf(linkage.stored_lists(spark, d), 10)


@query(with_(V.CHANNELS, V.GT, C.rrf_sql("10"), "g AS (SELECT DISTINCT ref_id, gt.cand_id, CASE b.doc_id % 2 WHEN 0 THEN 'latin' ELSE 'devanagari' END AS script FROM gt JOIN rec b ON b.entity_id = gt.cand_id)", "w AS (SELECT ref_id, cand_id, unnest([script, 'overall']) AS \"group\" FROM g)", "c AS (SELECT unnest([5, 10, 20, 50]) AS n)")
       + "SELECT w.\"group\", n, count(f.rank) AS hits, count(*) AS pairs, round(count(f.rank) / count(*), 6) AS recall FROM w CROSS JOIN c LEFT JOIN fused f ON f.ref_id = w.ref_id AND f.cand_id = w.cand_id AND f.rank <= n GROUP BY w.\"group\", n")
def recall_by_script(spark, d):
    """Recall at each cut by the script of the true candidates, here by turns."""
    groups = V.records(spark, d).select(F.col("entity_id").alias("cand_id"), F.when(F.col("doc_id") % 2 == 0, "latin").otherwise("devanagari").alias("group"))
    truth = V.truth(spark, d)
    return rounded(metrics.recall_by(fusion.rrf(C._lists(spark, d), 10, truth=truth), truth, groups))


@query(with_(V.CHANNELS, C.rrf_sql("10"), C.COARSE, C.CUT) + "SELECT cut.ref_id, cut.cand_id, cut.rank::INTEGER AS rank, round(fused.score, 9) AS rrf_score FROM cut JOIN fused USING (ref_id, cand_id)")
def signals_attached(spark, d):
    """Signals stored as a table and joined to the lists that they belong to."""
    kept = fusion.truncate(C._coarse(spark, d)).select("ref_id", "cand_id", "rank")
    signals = folders.stored(spark, "signals", [f"{d}/documents.parquet"], lambda: _fused(spark, d).select("ref_id", "cand_id", F.round("score", 9).alias("rrf_score")))
    return pairs.attach_signals(kept, signals, ["rrf_score"])


# features


WIDE = r"""wide AS (SELECT entity_id, doc_id,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE name_core END AS name_core, CASE WHEN doc_id % 7 = 0 THEN string_split(name_core, ' ')[1] || '.com' ELSE name_core END AS name_norm,
  CASE WHEN doc_id % 11 = 0 THEN []::VARCHAR[] ELSE list_filter(string_split(name_core, ' '), lambda t: t <> '') END AS name_tokens,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE addr_norm END AS addr_norm, list_filter(string_split(CASE WHEN doc_id % 17 = 0 THEN '' ELSE addr_norm END, ' '), lambda t: t <> '') AS addr_tokens,
  CASE doc_id % 3 WHEN 0 THEN (10000 + doc_id % 40)::VARCHAR WHEN 1 THEN '101' ELSE '' END AS addr_postal, CASE doc_id % 4 WHEN 0 THEN '12' WHEN 1 THEN '12-4' WHEN 2 THEN '1250' ELSE '' END AS addr_house_number,
  CASE doc_id % 4 WHEN 0 THEN 'il' WHEN 1 THEN 'tx' WHEN 2 THEN '' ELSE 'new york' END AS addr_state, CASE doc_id % 5 WHEN 0 THEN 'spring field' WHEN 1 THEN 'spring' WHEN 2 THEN '' ELSE 'austin' END AS addr_city,
  CASE doc_id % 3 WHEN 0 THEN 'limited' WHEN 1 THEN 'company' ELSE '' END AS name_legal_suffix,
  CASE doc_id % 4 WHEN 0 THEN ['12', '7'] WHEN 1 THEN ['12'] WHEN 2 THEN ['7', '8', '9'] ELSE []::VARCHAR[] END AS addr_digits,
  list_distinct(list_transform(list_filter(string_split(name_core, ' '), lambda t: t <> ''), lambda t: t[1:2])) AS name_phonetic, CASE doc_id % 6 WHEN 0 THEN 'devanagari' WHEN 1 THEN 'tamil' ELSE 'latin' END AS script_type,
  CASE doc_id % 9 WHEN 0 THEN 'us' ELSE bucket END AS country_norm, doc_id % 13 = 0 AS is_missing_name, doc_id % 17 = 0 AS is_missing_addr FROM rec)"""
WIDE_IDF = "idf AS (SELECT token, ln(((SELECT count(*) FROM wide) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct(name_tokens)) AS token FROM wide) GROUP BY token)"
WIDE_PAIRS = "wp AS (SELECT DISTINCT ref_id, cand_id, (rank - 1)::INTEGER AS rank, 1.0::DOUBLE / (10 + rank) AS rrf_score, rank / 3.0::DOUBLE AS agreement, CASE rank WHEN 1 THEN 4.0 WHEN 2 THEN 0.0 ELSE 0.25 END::DOUBLE AS phon, (rank - 2) / 2.0::DOUBLE AS dense FROM word WHERE rank <= 3)"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))) END"


def _grams(c: str, n: int) -> str:
    return f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len({c}) - {n - 1}, 1) + 1), lambda i: substr({c}, i, {n}))) END"


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence by bits of 128-bit integers: a step for each character of b."""
    full = f"((1::HUGEINT << len({a})) - 1)"
    mask = f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT"
    return f"len({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask})), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * ({_lcs(a, b)}) / (len({a}) + len({b})) END"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN greatest({a}, {b}) = 0 THEN 0 ELSE least({a}, {b}) / greatest({a}, {b}) END"


def _equal(c: str) -> str:
    return _flag(f"a.{c} <> '' AND a.{c} = b.{c}")


def _sorted(s: str) -> str:
    return f"array_to_string(list_sort({s}), ' ')"


DOMAIN = lists.DOMAIN
STREET = "list_filter({s}.addr_tokens, lambda t: t <> {s}.addr_house_number AND t <> {s}.addr_postal AND NOT list_contains(string_split({s}.addr_state, ' '), t) AND NOT list_contains(string_split({s}.addr_city, ' '), t))"
TOKENS = "CASE WHEN len({s}.name_tokens) > 0 THEN {s}.name_tokens ELSE list_filter(string_split({s}.name_core, ' '), lambda t: t <> '') END"
WEIGHTS = "coalesce((SELECT sum(idf) FROM idf WHERE list_contains({t}, idf.token)), 0)"
CITY = "list_filter(string_split({s}.addr_city, ' '), lambda t: t <> '')"
LEAD = "regexp_extract({s}.addr_house_number, '^([0-9]+)', 1)"
FEATURES = {
    "name_ratio": _ratio("a.name_core", "b.name_core"),
    "name_jaro_winkler": "CASE WHEN a.name_core = '' OR b.name_core = '' THEN 0 ELSE jaro_winkler_similarity(a.name_core, b.name_core) END",
    "name_token_sort": _ratio("sa", "sb"),
    "name_char3_jaccard": _jac(_grams("a.name_core", 3), _grams("b.name_core", 3)),
    "name_token_jaccard": _jac(TOKENS.format(s="a"), TOKENS.format(s="b")),
    "name_idf_overlap": f"CASE WHEN {WEIGHTS.format(t='list_concat(a.name_tokens, b.name_tokens)')} = 0 THEN 0 ELSE {WEIGHTS.format(t='list_intersect(a.name_tokens, b.name_tokens)')} / {WEIGHTS.format(t='list_concat(a.name_tokens, b.name_tokens)')} END",
    "name_legal_suffix_match": _equal("name_legal_suffix"),
    "name_char5_jaccard": _jac(_grams("a.name_core", 5), _grams("b.name_core", 5)),
    "name_script_eq": _flag("a.script_type = b.script_type"),
    "name_missing_xor": _flag("a.is_missing_name <> b.is_missing_name"),
    "name_is_domain_xor": _flag(f"regexp_matches(a.name_norm, '{DOMAIN}') <> regexp_matches(b.name_norm, '{DOMAIN}')"),
    "name_phonetic_jaccard": _jac("a.name_phonetic", "b.name_phonetic"),
    "addr_house_exact": _equal("addr_house_number"),
    "addr_street_jaccard": _jac(STREET.format(s="a"), STREET.format(s="b")),
    "addr_postal_exact": _equal("addr_postal"),
    "addr_postal_prefix3": _flag("len(a.addr_postal) >= 3 AND len(b.addr_postal) >= 3 AND a.addr_postal[1:3] = b.addr_postal[1:3]"),
    "addr_city_exact": _equal("addr_city"),
    "addr_state_match": _equal("addr_state"),
    "addr_token_jaccard": _jac("a.addr_tokens", "b.addr_tokens"),
    "addr_char3_jaccard": _jac(_grams("a.addr_norm", 3), _grams("b.addr_norm", 3)),
    "addr_digit_conflict": _flag("len(a.addr_digits) > 0 AND len(b.addr_digits) > 0 AND len(list_intersect(a.addr_digits, b.addr_digits)) = 0"),
    "addr_house_prefix": _flag(f"{LEAD.format(s='a')} <> '' AND {LEAD.format(s='b')} <> '' AND {LEAD.format(s='a')}[1:3] = {LEAD.format(s='b')}[1:3]"),
    "addr_house_conflict": _flag(f"{LEAD.format(s='a')} <> '' AND {LEAD.format(s='b')} <> '' AND {LEAD.format(s='a')} <> {LEAD.format(s='b')}"),
    "addr_city_token_jaccard": _jac(CITY.format(s="a"), CITY.format(s="b")),
    "ret_exact_key_hit": _flag("a.name_core <> '' AND a.name_core = b.name_core"),
    "ret_rrf_score": "rrf_score",
    "ret_retriever_agreement": "agreement",
    "ret_candidate_rank": "rank",
    "ret_retrieved": _flag("rank >= 0"),
    "ret_rank_inverse": "1.0::DOUBLE / (rank + 1)",
    "ret_phon_score": "phon",
    "ret_phon_hit": _flag("phon > 0"),
    "ret_dense_score": "greatest(dense, 0)",
    "ret_dense_hit": _flag("dense > 0"),
    "struct_same_country": _flag("a.country_norm = b.country_norm"),
    "struct_name_len_ratio": _share("len(a.name_core)", "len(b.name_core)"),
    "struct_addr_len_ratio": _share("len(a.addr_norm)", "len(b.addr_norm)"),
    "struct_addr_missing_xor": _flag("a.is_missing_addr <> b.is_missing_addr"),
    "struct_addr_missing_both": _flag("a.is_missing_addr AND b.is_missing_addr"),
    "struct_name_missing_both": _flag("a.is_missing_name AND b.is_missing_name"),
    "struct_name_script_latin_xor": _flag("(a.script_type = 'latin') <> (b.script_type = 'latin')"),
    "struct_addr_digit_count_ratio": _share("len(a.addr_digits)", "len(b.addr_digits)"),
}
WIDE_SQL = with_(V.REC.replace("array_to_string(toks[1:4], ' ') AS name_core", "array_to_string(list_transform(toks[1:4], lambda t: replace(strip_accents(t), 'ß', 'ss')[1:24]), ' ') AS name_core"), V.WORD, WIDE, WIDE_IDF, WIDE_PAIRS, f"sw AS (SELECT *, {_sorted('list_filter(string_split(name_core, chr(32)), lambda t: t <> chr(32)[2:])')} AS s FROM wide)")


def _wide(spark, d):
    """Records with fields that differ by turns, so that no feature is constant; names without accents, since an SQL function counts bytes."""
    from kinweave.functions import arrow

    n = F.col("doc_id")
    by = lambda m, *xs: F.element_at(F.array(*xs), F.least(F.pmod(n, F.lit(m)), F.lit(len(xs) - 1)).cast("int") + 1)
    lit = F.lit
    short = F.array_join(F.transform(F.split(F.replace(arrow.without_accents(F.array_join(F.slice("toks", 1, 4), " ")), F.lit("ß"), F.lit("ss")), " "), lambda t: F.substring(t, 1, 24)), " ")
    rec = V.records(spark, d).withColumn("name_core", short)
    own = text.tokens(F.col("name_core"))
    none = F.array().cast("array<string>")
    digits = F.when(n % 4 == 0, F.array(lit("12"), lit("7"))).when(n % 4 == 1, F.array(lit("12"))).when(n % 4 == 2, F.array(lit("7"), lit("8"), lit("9"))).otherwise(none)
    addr = F.when(n % 17 == 0, "").otherwise(F.col("addr_norm"))
    return rec.select(
        "entity_id", F.when(n % 13 == 0, "").otherwise(F.col("name_core")).alias("name_core"), F.when(n % 7 == 0, F.concat(F.coalesce(F.get(F.split("name_core", " "), 0), lit("")), lit(".com"))).otherwise(F.col("name_core")).alias("name_norm"),
        F.when(n % 11 == 0, none).otherwise(own).alias("name_tokens"), addr.alias("addr_norm"), text.tokens(addr).alias("addr_tokens"), F.when(n % 3 == 0, (10000 + n % 40).cast("string")).when(n % 3 == 1, "101").otherwise("").alias("addr_postal"),
        by(4, lit("12"), lit("12-4"), lit("1250"), lit("")).alias("addr_house_number"), by(4, lit("il"), lit("tx"), lit(""), lit("new york")).alias("addr_state"), by(5, lit("spring field"), lit("spring"), lit(""), lit("austin")).alias("addr_city"),
        by(3, lit("limited"), lit("company"), lit("")).alias("name_legal_suffix"), digits.alias("addr_digits"), F.array_distinct(F.transform(own, lambda t: F.substring(t, 1, 2))).alias("name_phonetic"), by(6, lit("devanagari"), lit("tamil"), lit("latin")).alias("script_type"),
        F.when(n % 9 == 0, "us").otherwise(F.col("bucket")).alias("country_norm"), (n % 13 == 0).alias("is_missing_name"), (n % 17 == 0).alias("is_missing_addr"),
    )


def _wide_features(spark, d):
    rec = _wide(spark, d)
    rec = folders.checkpoint(rec)
    full = folders.checkpoint(features.with_weights(rec, features.idf_table(rec), rec.count()))
    rank = F.col("rank")
    found = blocking.word_channel(*V.sides(spark, d), k=3)
    signals = found.select("ref_id", "cand_id", (rank - 1).alias("rank"), (1.0 / (10 + rank)).alias("rrf_score"), (rank / 3.0).alias("channel_agreement"), F.when(rank == 1, 4.0).when(rank == 2, 0.0).otherwise(0.25).alias("phon_score"), ((rank - 2) / 2.0).alias("dense_score"))
    truth = V.truth(spark, d).distinct().withColumn("label", F.lit(1))
    return features.features(signals.join(truth, ["ref_id", "cand_id"], "left"), full)


@query(WIDE_SQL + "SELECT ref_id, cand_id, " + ", ".join(f"floor(({x})::FLOAT::DOUBLE * 10000 + 0.5::DOUBLE) / 10000 AS {n}" for n, x in FEATURES.items()) + " FROM wp JOIN (SELECT *, s AS sa FROM sw) a ON a.entity_id = ref_id JOIN (SELECT *, s AS sb FROM sw) b ON b.entity_id = cand_id")
def features_wide(spark, d):
    """42 of the 45 features on records where none is constant; the other three compare windows or sets of words."""
    f = _wide_features(spark, d)
    return f.select("ref_id", "cand_id", *[(F.floor(F.col(n).cast("double") * 10000 + 0.5) / 10000).alias(n) for n in FEATURES])


RATES = {"name_token_jaccard": 0.5, "addr_token_jaccard": 0.8, "ret_exact_key_hit": 1.0}


@query(WIDE_SQL.rstrip() + ",\n" + V.GT + " SELECT signal, threshold, round(avg(CASE WHEN v >= threshold THEN 1.0 ELSE 0 END), 6) AS share FROM (SELECT unnest([" + ", ".join(f"{{'signal': '{n}', 'threshold': {t}::DOUBLE, 'v': ({FEATURES[n]})::FLOAT::DOUBLE}}" for n, t in RATES.items()) + "], recursive := true) FROM wp JOIN wide a ON a.entity_id = ref_id JOIN wide b ON b.entity_id = cand_id SEMI JOIN gt USING (ref_id, cand_id)) GROUP BY signal, threshold")
def signal_rates(spark, d):
    return rounded(audit.signal_rates(_wide_features(spark, d), RATES))


@query(with_(V.REC, V.EXACT, "p AS (SELECT CASE WHEN rank % 3 = 0 THEN ref_id || 'x' ELSE ref_id END AS ref_id, CASE WHEN rank % 2 = 0 THEN cand_id || 'x' ELSE cand_id END AS cand_id FROM exact)") + "SELECT count(*) FILTER (ref_id NOT IN (SELECT entity_id FROM rec)) AS no_ref, count(*) FILTER (cand_id NOT IN (SELECT entity_id FROM rec)) AS no_cand FROM p")
def missing_pair_records(spark, d):
    broken = lambda c, n: F.when(F.col("rank") % n == 0, F.concat(c, F.lit("x"))).otherwise(F.col(c)).alias(c)
    found = blocking.exact_channel(*V.sides(spark, d)).select(broken("ref_id", 3), broken("cand_id", 2))
    return features.missing_records(found, V.records(spark, d))


@query(with_(V.CHANNELS, V.GT, V.REFS, C.rrf_sql("10"), *C.SAMPLE) + "SELECT neg_type, count(*) AS n_pairs, count(DISTINCT ref_id) AS n_refs, sum(label)::BIGINT AS n_positive FROM (SELECT ref_id, 'pos' AS neg_type, 1 AS label FROM m WHERE label = 1 UNION ALL SELECT ref_id, 'hard', 0 FROM o JOIN c USING (ref_id) WHERE place <= CASE WHEN nt = 0 THEN 3 ELSE 3 * np END) GROUP BY neg_type")
def pair_variant_without_easy(spark, d):
    return pairs.summary(pairs.without_easy(C._sampled(spark, d)))


# decisions and diagnostics


def _one_step(spark, d):
    return C._scored(spark, d), C._refs(spark, d), V.truth(spark, d)


OPEN = "par AS (SELECT a::DOUBLE AS boost, b::DOUBLE AS veto FROM (SELECT unnest([0.0, 0.1, 0.2]) AS a), (SELECT unnest([0.0, 0.3, 0.5, 0.6, 0.7]) AS b)), g AS (SELECT DISTINCT * FROM gt), tt AS (SELECT ref_id, count(*) AS t FROM g GROUP BY ref_id), hp AS (SELECT boost, veto, k.ref_id, count(*) AS p, count(g.cand_id) AS h FROM (SELECT * FROM pk, par WHERE NOT (peak < 0.3::DOUBLE + boost OR peak < veto) AND prob >= greatest(0.5::DOUBLE, peak - 0.05::DOUBLE)) k LEFT JOIN g ON g.ref_id = k.ref_id AND g.cand_id = k.cand_id GROUP BY boost, veto, k.ref_id)"


@query(with_(V.SCORED, C.PEAK, OPEN) + f"SELECT bucket AS held, boost, veto, round(avg({C.F05}), 6) AS macro_f05 FROM (SELECT r.bucket, par.boost, par.veto, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(h, 0) AS h FROM refs r CROSS JOIN par LEFT JOIN tt USING (ref_id) LEFT JOIN hp ON hp.ref_id = r.ref_id AND hp.boost = par.boost AND hp.veto = par.veto WHERE r.bucket <> 'fr') GROUP BY bucket, boost, veto")
def open_set_tuning(spark, d):
    """Each labelled bucket held out in turn and treated as open."""
    return rounded(decision.tune_open_set(*_one_step(spark, d)))


V1_EXACT, V2_EXACT = (C.SQL[n].replace(", 6) AS macro_f05", ", 12) AS macro_f05") for n in ("decision_v1_grid", "decision_v2_grid"))


@query(f"SELECT rule, a, b, macro_f05 FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY macro_f05 DESC, a, b) AS place FROM (SELECT 'thresholds' AS rule, tau_match AS a, tau_s AS b, macro_f05 FROM ({V1_EXACT}) UNION ALL SELECT 'expected', recall_hat, tau_floor, macro_f05 FROM ({V2_EXACT}))) WHERE place = 1")
def compare_rules(spark, d):
    """The best thresholds beside the best expected F0.5 on the same scores."""
    return decision.compare(*_one_step(spark, d)).withColumn("macro_f05", F.round("macro_f05", 12))


MIX = "CASE WHEN bool_or(cand_id LIKE 'S2-%') AND bool_or(cand_id LIKE 'S3-%') THEN 's2+s3' WHEN bool_or(cand_id LIKE 'S2-%') THEN 's2' WHEN bool_or(cand_id LIKE 'S3-%') THEN 's3' ELSE 'none' END"
LENGTH = "CASE WHEN len({c}) = 0 THEN '0' WHEN len({c}) <= 10 THEN '1-10' WHEN len({c}) <= 20 THEN '11-20' WHEN len({c}) <= 40 THEN '21-40' ELSE '41+' END"
CLASSED = (f"cl AS (SELECT ev.*, {C.CLASS} AS c, {C.F05} AS f, CASE WHEN p = 0 THEN 0 ELSE h / p END AS pr, CASE WHEN t = 0 THEN 0 ELSE h / t END AS re, coalesce(pm.m, 'none') AS pred_source, coalesce(gm.m, 'none') AS gt_source, {LENGTH.format(c='rec.name_core')} AS name_bucket, {LENGTH.format(c='rec.addr_norm')} AS addr_bucket, CASE WHEN regexp_matches(rec.name_core, '[A-\\x{{24F}}]') THEN 'latin' ELSE 'other' END AS script FROM ev JOIN rec ON rec.entity_id = ev.ref_id LEFT JOIN (SELECT ref_id, {MIX} AS m FROM pred GROUP BY ref_id) pm USING (ref_id) LEFT JOIN (SELECT ref_id, {MIX} AS m FROM gt GROUP BY ref_id) gm USING (ref_id))",)
GROUPED = "SELECT '{k}' AS dimension, {k} AS \"group\", count(*) AS n, round(avg(f), 6) AS macro_f05, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, count(*) FILTER (c = 'true_singleton') AS true_singleton, count(*) FILTER (c = 'false_positive') AS false_positive, count(*) FILTER (c = 'miss') AS miss, count(*) FILTER (c = 'exact') AS exact, count(*) FILTER (c = 'partial') AS partial, round(coalesce(avg(f) FILTER (c = 'true_singleton'), 0), 6) AS singleton_mean, round(coalesce(avg(f) FILTER (c <> 'true_singleton'), 0), 6) AS match_mean FROM cl GROUP BY {k}"


def _classes(spark, d):
    scores, refs, truth = _one_step(spark, d)
    return audit.with_dimensions(audit.error_classes(V.references(spark, d), truth, decision.decide(scores, refs)), V.records(spark, d))


@query(with_(V.SCORED, C.PEAK, C.DECIDED, C.EVAL, *CLASSED) + " UNION ALL ".join(GROUPED.format(k=k) for k in audit.DIMENSIONS))
def diagnostics(spark, d):
    """Outcomes by six dimensions."""
    return rounded(audit.diagnostics(_classes(spark, d)))


@query(with_(V.SCORED, C.PEAK, C.DECIDED, C.EVAL, *CLASSED) + "SELECT c AS error_class, count(*) AS n, round(count(*) / (SELECT count(*) FROM cl), 6) AS share, round(sum(f), 4) AS f05_mass FROM cl GROUP BY c")
def error_focus(spark, d):
    found = audit.error_focus(_classes(spark, d))
    return found.withColumn("share", F.round("share", 6))


@query(with_(V.SCORED, C.PEAK, C.DECIDED, "per AS (SELECT r.ref_id, (SELECT count(*) FROM pred WHERE pred.ref_id = r.ref_id) AS n, (SELECT max(prob) FROM probs WHERE probs.ref_id = r.ref_id) AS peak FROM refs r WHERE r.bucket = 'fr')") + "SELECT count(*) AS n_refs, count(*) FILTER (n > 0) AS non_empty, round(avg(n), 6) AS mean_pred, round(quantile_cont(peak, 0.5), 6) AS median_peak FROM per")
def open_set_spot_check(spark, d):
    scores, refs, _ = _one_step(spark, d)
    return rounded(audit.spot_check(refs.where("is_open"), decision.decide(scores, refs), scores)[0])


@query(with_(V.REC, V.GT, V.WORD, "ms AS (SELECT DISTINCT ref_id, cand_id FROM gt WHERE NOT EXISTS (SELECT 1 FROM word w WHERE w.ref_id = gt.ref_id AND w.cand_id = gt.cand_id AND w.rank = 1))",
             "pr AS (SELECT a.name_core AS na, b.name_core AS nb, a.addr_norm AS aa, b.addr_norm AS ab, " + ", ".join(_jac(f"list_filter(string_split(a.{c}, ' '), lambda t: t <> '')", f"list_filter(string_split(b.{c}, ' '), lambda t: t <> '')") + f" AS {n}" for c, n in (("name_core", "jn"), ("addr_norm", "ja"))) + ", regexp_matches(a.name_core, '[A-\\x{24F}]') AS la, regexp_matches(b.name_core, '[A-\\x{24F}]') AS lb FROM ms JOIN rec a ON a.entity_id = ref_id JOIN rec b ON b.entity_id = cand_id)")
       + "SELECT count(*) AS missed, " + ", ".join(f"round(coalesce(avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END), 0), 6) AS {n}" for n, x in (("same_name", "na = nb"), ("similar_name", "jn >= 0.5"), ("other_name", "jn < 0.5"), ("similar_address", "ja >= 0.5"), ("missing_both", "aa = '' AND ab = ''"), ("missing_address", "(aa = '') <> (ab = '')"), ("other_both", "jn < 0.5 AND ja < 0.5"), ("cross_script", "la <> lb"))) + " FROM pr")
def missed_profile(spark, d):
    return rounded(audit.missed_profile(V.truth(spark, d), blocking.word_channel(*V.sides(spark, d), k=1), V.records(spark, d)))


@query(with_(V.REC, V.GT, "hd AS (SELECT DISTINCT ref_id, cand_id FROM gt ORDER BY ref_id, cand_id LIMIT 20)") + "SELECT ref_id, cand_id, a.name_core AS ref_name, a.addr_norm AS ref_addr, b.name_core AS cand_name, b.addr_norm AS cand_addr FROM hd JOIN rec a ON a.entity_id = ref_id JOIN rec b ON b.entity_id = cand_id")
def inspect_true_pairs(spark, d):
    rec = V.records(spark, d).withColumnsRenamed({"name_core": "name_raw", "addr_norm": "addr_raw"})
    return audit.inspect_pairs(V.truth(spark, d), rec).select("ref_id", "cand_id", F.col("ref.name_raw").alias("ref_name"), F.col("ref.addr_raw").alias("ref_addr"), F.col("cand.name_raw").alias("cand_name"), F.col("cand.addr_raw").alias("cand_addr"))


PLACED = "pl AS (SELECT entity_id, src, row_number() OVER (PARTITION BY bucket, src = 1 ORDER BY seq) AS place FROM rec)"


@query(with_(V.REC, V.GT, PLACED) + "SELECT b.place - a.place AS \"offset\", count(*) AS n FROM (SELECT DISTINCT * FROM gt) g JOIN pl a ON a.entity_id = ref_id JOIN pl b ON b.entity_id = cand_id GROUP BY 1")
def rank_arithmetic(spark, d):
    return audit.rank_offsets(*V.sides(spark, d), V.truth(spark, d))


OTHER_KNOTS = [(0.0, 0.1), (1.0, 0.9)]
BY_KNOTS = "CASE WHEN prob <= 0.1 THEN 0.0 WHEN prob < 0.3 THEN (prob - 0.1) * 0.5 WHEN prob < 0.6 THEN 0.1 + (prob - 0.3) * 4 / 3 WHEN prob < 0.9 THEN 0.5 + (prob - 0.6) * 1.5 ELSE 0.95 END"


@query(with_(V.SCORED) + f"SELECT ref_id, cand_id, round(CASE bucket WHEN 'en' THEN {BY_KNOTS} WHEN 'de' THEN 0.1 + prob * 0.8 ELSE prob END, 9) AS calibrated_prob FROM probs JOIN refs USING (ref_id)")
def calibrate_buckets(spark, d):
    """Each bucket by its own knots, raw scores elsewhere."""
    rows = C._scored(spark, d).join(V.references(spark, d).select("ref_id", "bucket"), "ref_id")
    found = models.calibrate_by_bucket(rows, {"en": C.KNOTS, "de": OTHER_KNOTS})
    return found.select("ref_id", "cand_id", F.round("calibrated_prob", 9).alias("calibrated_prob"))


ECE = "round(sum(n * abs(mp - pr)) / sum(n), 6) AS ece FROM (SELECT option, count(*) AS n, avg(p) AS mp, avg(label) AS pr FROM op GROUP BY option, least(14, floor(p * 15))) GROUP BY option"


@query(with_(V.SCORED, C.LABELLED, f"op AS (SELECT 'none' AS option, prob AS p, label FROM lb UNION ALL SELECT 'global', {BY_KNOTS}, label FROM lb)", "ec AS (SELECT option, " + ECE + ")") + "SELECT option, ece, option <> 'none' AND (SELECT ece FROM ec WHERE option = 'none') - ece >= 0.005 AS pays FROM ec")
def calibration_gain(spark, d):
    """The calibration errors of raw and calibrated scores, and whether the gain is enough."""
    rows = C._labelled(spark, d)
    options = F.array(*[F.struct(F.lit(name).alias("option"), p.alias("prob")) for name, p in (("none", F.col("prob")), ("global", models.apply_knots(F.col("prob"), C.KNOTS)))])
    errors = metrics.ece(rows.select("label", F.inline(options)), by=["option"])  # pairs meet the truth once for both
    found = {"none": 0.0, "global": 0.0} | {r["option"]: round(r["ece"], 6) for r in errors.collect()}
    return spark.createDataFrame([(k, e, k != "none" and models.adopt_calibration(found["none"], e, 0.0, 0.0)) for k, e in found.items()], "option string, ece double, pays boolean")


@query(with_(V.REFS) + "SELECT bucket, 'present' AS state, count(*) AS expected, count(*) AS found FROM refs GROUP BY bucket UNION ALL SELECT 'xx', 'out of scope', 0, 0")
def artifact_coverage(spark, d):
    """Stored tables of each bucket against the plan; a bucket that the plan gives nothing needs none."""
    root = folders.new_folder(spark, "coverage")
    refs = V.references(spark, d)
    sinks.write_table(refs.select("ref_id", "bucket"), sinks.artifact(root, "lists", "train"), ["bucket"])
    plan = audit.planned_counts(refs) | {"xx": 0}
    found = audit.check_artifacts(spark, {b: sinks.artifact(root, "lists", "train", b) for b in plan}, plan)
    return spark.createDataFrame([(b, x["state"], x["expected"], x["found"]) for b, x in found.items()], "bucket string, state string, expected long, found long")


# a whole run


NREC = NORMAL + ",\n" + "vrec AS (SELECT * FROM rec), nrec AS (SELECT entity_id, src, doc_id, entity_id AS seq, country_norm AS bucket, trim(name_core || ' ' || addr_norm) AS text, name_core, addr_norm, addr_postal, addr_house_number, addr_tokens FROM normal)"
RUN = [x.replace("FROM rec", "FROM nrec").replace("JOIN rec", "JOIN nrec") for x in (V.EXACT, V.WORD, V.CHAR, V.LISTS)]
LINEAR = f"""pb AS (SELECT c.ref_id, c.cand_id, a.bucket, round((({_jac(_grams('a.name_core', 3), _grams('b.name_core', 3))})::FLOAT::DOUBLE + ({_jac('a.addr_tokens', 'b.addr_tokens')})::FLOAT::DOUBLE + ({_share('len(a.name_core)', 'len(b.name_core)')})::FLOAT::DOUBLE) / 3, 5) AS prob
  FROM cut c JOIN nrec a ON a.entity_id = c.ref_id JOIN nrec b ON b.entity_id = c.cand_id),
pp AS (SELECT *, max(prob) OVER (PARTITION BY ref_id) AS peak FROM pb)"""


def linear(table):
    """A fixed linear score of three features, in place of a trained model."""
    parts = (F.col(n).cast("double") for n in ("name_char3_jaccard", "addr_token_jaccard", "struct_name_len_ratio"))
    first, second, third = parts
    return table.withColumn("prob", F.round((first + second + third) / 3, 5))


@query(with_(V.REC, NREC, *RUN, C.rrf_sql("10"), C.COARSE, C.CUT, LINEAR) + "SELECT ref_id, cand_id, prob FROM pp WHERE NOT (peak < 0.3::DOUBLE + 0.1::DOUBLE OR peak < 0.5) AND prob >= greatest(0.5::DOUBLE, peak - 0.05::DOUBLE)")
def link_records(spark, d):
    """Raw records to match sets: normalise, retrieve by three channels, fuse, truncate, compute features, score, decide.

    Every bucket but france is unseen, so all references are open ones.
    """
    raw = V.records(spark, d).select("entity_id", F.col("name_core").alias("business_name"), F.col("addr_norm").alias("business_address"), F.col("bucket").alias("country"))
    return linkage.link(normalise.normalise(raw, address_script=True), linear)
