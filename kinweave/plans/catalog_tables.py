"""Queries of sources, sinks and projections: each writes with the library's writers, reads back with its readers, and
must give what plain SQL says of the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinweave.functions import address, arrow, lists, text
from kinweave.operators import blocking, decision, dense, normalise, pairs
from kinweave.plans import linkage, views
from kinweave.plans.registry import query, with_, words
from kinweave.sources import folders, records, sinks
from kinweave.streaming import topk

V = views


def _raw(spark, d):
    """Records as a raw source has them."""
    return V.records(spark, d).select("entity_id", F.col("name_core").alias("business_name"), F.col("addr_norm").alias("business_address"), F.col("bucket").alias("country"))


def _refs(spark, d):
    return V.references(spark, d).select("ref_id")


@query(with_(V.REC) + "SELECT entity_id, name_core AS business_name, addr_norm AS business_address, bucket AS country FROM rec WHERE src = 2")
def scan_raw_tsv(spark, d):
    folder = folders.new_folder(spark, "raw")
    _raw(spark, d).where("entity_id LIKE 'S2-%'").write.csv(folder, sep="\t", header=True, quote="", emptyValue="")
    return records.read_source(spark, folder, 2)


def _truth_file(spark, d) -> str:
    folder = folders.new_folder(spark, "truth")
    sinks.write_id_lists(_refs(spark, d), V.truth(spark, d), folder)
    return folder


@query(with_(V.REC, V.GT) + "SELECT DISTINCT ref_id, cand_id FROM gt")
def scan_truth(spark, d):
    references = _refs(spark, d).select(F.col("ref_id").alias("entity_id"))
    return records.read_truth(spark, _truth_file(spark, d), references)[1]


@query(with_(V.REC, V.GT, V.REFS) + "SELECT r.ref_id, count(g.cand_id) AS n FROM refs r LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (ref_id) WHERE r.doc_id % 2 = 0 GROUP BY r.ref_id")
def scan_truth_scope(spark, d):
    """The references in scope, with those that match nothing."""
    own = V.references(spark, d)
    refs, found = records.read_truth(spark, _truth_file(spark, d), own.select(F.col("ref_id").alias("entity_id")), own.where("doc_id % 2 = 0").select("ref_id"))
    return refs.join(found, "ref_id", "left").groupBy("ref_id").agg(F.count("cand_id").alias("n"))


@query(with_(V.REC, V.EXACT) + "SELECT ref_id, cand_id, rank::INTEGER AS rank FROM exact")
def scan_candidate_list(spark, d):
    folder = folders.new_folder(spark, "candidates")
    sinks.write_id_lists(_refs(spark, d), blocking.exact_channel(*V.sides(spark, d)), folder, "candidate_entity_ids", "rank")
    return records.read_candidates(spark, folder, strict=True)[1]


NAMES = "CASE doc_id % 4 WHEN 0 THEN 'usa' WHEN 1 THEN 'us' WHEN 2 THEN 'fr' ELSE '' END"


def _shards(spark, d):
    """Normalised records in two shards, of which the second repeats some ids with other names."""
    folder = folders.new_folder(spark, "shards")
    n = F.col("doc_id") % 4
    rows = V.records(spark, d).withColumn("country_norm", F.when(n == 0, "usa").when(n == 1, "us").when(n == 2, "fr").otherwise(""))
    rows = rows.select("entity_id", "country_norm", "name_core", "addr_norm", "doc_id")
    sinks.write_table(rows.coalesce(1), f"{folder}/part=0")
    sinks.write_table(rows.where("doc_id % 8 = 0").withColumn("name_core", F.lit("again")).coalesce(1), f"{folder}/part=1")
    return folder


@query(with_(V.REC) + f"SELECT entity_id, name_core FROM rec WHERE {NAMES} IN ('us', 'usa')")
def scan_bucket_rows(spark, d):
    """A bucket under all names of its country, the first row of each id."""
    return records.scan_bucket(spark, _shards(spark, d), "us", ["entity_id", "name_core"])


@query(with_(V.REC) + f"SELECT entity_id FROM rec WHERE {NAMES} IN ('us', 'usa') AND src = 1 ORDER BY entity_id LIMIT 25")
def scan_bucket_head(spark, d):
    ids = V.references(spark, d).select(F.col("ref_id").alias("entity_id"))
    return records.scan_bucket(spark, _shards(spark, d), "us", ["entity_id"], ids, 25)


@query(with_(V.REC) + "SELECT entity_id AS id, CASE bucket WHEN 'fr' THEN 'france' ELSE bucket END AS bucket, src = 1 AS is_reference FROM rec")
def split_sides(spark, d):
    rows = _raw(spark, d).select("entity_id", text.source_of(F.col("entity_id")).alias("source"), F.col("country").alias("country_norm"))
    refs, cands = records.references_and_candidates(rows)
    return refs.select("id", "bucket", F.lit(True).alias("is_reference")).unionByName(cands.select("id", "bucket", F.lit(False).alias("is_reference")))


@query(with_(V.REC) + "SELECT entity_id, name_core, addr_norm FROM rec WHERE doc_id % 7 = 0")
def lookup_records(spark, d):
    ids = V.records(spark, d).where("doc_id % 7 = 0").select("entity_id")
    return records.lookup(V.records(spark, d), ids.unionByName(ids)).select("entity_id", "name_core", "addr_norm")


@query(with_(V.REFS) + "SELECT DISTINCT ref_id FROM refs")
def all_reference_ids(spark, d):
    rows = V.records(spark, d).select("entity_id")
    return records.reference_ids(rows.unionByName(rows))


def _normalised(spark, d):
    """Addresses lose their accents by their own script, as in the SQL: some names are just numbers."""
    return normalise.normalise(_raw(spark, d), address_script=True)


LATIN_NAME = "strip_accents(name_core)"
KEPT = f"list_filter(string_split({LATIN_NAME}, ' '), lambda t: t <> '')"
CORE = f"array_to_string(CASE WHEN len(list_filter({KEPT}, lambda t: t NOT IN ({words(lists.STOPWORDS)}))) = 0 THEN {KEPT} ELSE list_filter({KEPT}, lambda t: t NOT IN ({words(lists.STOPWORDS)})) END, ' ')"
#: Buckets of the test tables are languages: of the countries with rules only fr is among them.
COUNTRY = "CASE bucket WHEN 'fr' THEN 'france' ELSE bucket END"
SCRIPT = r"CASE WHEN regexp_matches({c}, '[A-\x{{24F}}]') THEN 'latin' ELSE 'other' END"
FRENCH = "list_transform(k, lambda t: CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lists.ABBREVIATIONS["france"].items()) + " ELSE t END)"
FRENCH_TAIL = "CASE " + " ".join(f"WHEN len(w) >= {k} AND array_to_string(w[-{k}:], ' ') IN ({words(lists.LEGAL_SUFFIXES['france'])}) THEN array_to_string(w[-{k}:], ' ')" for k in range(5, 0, -1)) + " ELSE '' END"
IN_LIST = words(lists.STOPWORDS)
#: Records as normalise gives them on these tables.
NORMAL = f"""n1 AS (SELECT entity_id, src, doc_id, bucket, {COUNTRY} AS country_norm, name_core AS name_raw, addr_norm AS addr_raw, {KEPT} AS k, list_filter(string_split(strip_accents(addr_norm), ' '), lambda t: t <> '') AS addr_tokens FROM rec),
n2 AS (SELECT *, CASE WHEN bucket = 'fr' THEN list_filter(string_split(array_to_string({FRENCH}, ' '), ' '), lambda t: t <> '') ELSE k END AS w FROM n1),
n3 AS (SELECT *, CASE WHEN bucket = 'fr' THEN {FRENCH_TAIL} ELSE '' END AS name_legal_suffix FROM n2),
n4 AS (SELECT *, w[1:len(w) - CASE name_legal_suffix WHEN '' THEN 0 ELSE len(string_split(name_legal_suffix, ' ')) END] AS rest FROM n3),
normal AS (SELECT entity_id, src, doc_id, bucket, country_norm, name_raw, addr_raw, array_to_string(w, ' ') AS name_norm, w AS name_tokens, name_legal_suffix, addr_tokens, array_to_string(addr_tokens, ' ') AS addr_norm,
  array_to_string(CASE WHEN len(list_filter(rest, lambda t: t NOT IN ({IN_LIST}))) = 0 THEN rest ELSE list_filter(rest, lambda t: t NOT IN ({IN_LIST})) END, ' ') AS name_core,
  CASE WHEN bucket = 'fr' THEN coalesce(regexp_extract_all(array_to_string(addr_tokens, ' '), '{lists.POSTAL["france"]}')[-1], '') ELSE '' END AS addr_postal,
  coalesce(list_filter(addr_tokens, lambda t: regexp_full_match(t, '\\p{{Nd}}+(-\\p{{Nd}}+)?'))[1], '') AS addr_house_number,
  coalesce(list_filter(addr_tokens, lambda t: regexp_full_match(t, '\\p{{L}}+'))[-1], '') AS last_word,
  list_filter(list_transform(range(3, 0, -1), lambda n: CASE WHEN bucket = 'fr' AND len(addr_tokens) >= n THEN array_to_string(addr_tokens[-n:], ' ') ELSE '' END), lambda x: x IN ({words(lists.STATES['france'])}))[1] AS state_found
  FROM n4)"""


@query(with_(V.REC, NORMAL) + "SELECT entity_id, country_norm, name_norm, name_legal_suffix, name_core, addr_norm, addr_postal, addr_house_number, coalesce(state_found, '') AS addr_state, trim(name_raw) = '' AS is_missing_name, trim(addr_raw) = '' AS is_missing_addr, addr_postal = '' AS is_missing_postal, state_found IS NULL AS is_missing_state FROM normal")
def normalised_fields(spark, d):
    """What normalise makes of records, but for the fields that need phonetics."""
    return _normalised(spark, d).select("entity_id", "country_norm", "name_norm", "name_legal_suffix", "name_core", "addr_norm", "addr_postal", "addr_house_number", "addr_state", "is_missing_name", "is_missing_addr", "is_missing_postal", "is_missing_state")


@query(with_(V.REC, NORMAL) + "SELECT entity_id, country_norm, name_norm, name_core, addr_norm, " + SCRIPT.format(c="name_raw") + " AS script_type, trim(addr_raw) = '' AS is_missing_addr FROM normal WHERE src = 1 AND doc_id % 2 = 0")
def reference_metadata(spark, d):
    return records.reference_metadata(_normalised(spark, d), V.references(spark, d).where("doc_id % 2 = 0"))


@query("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS n")
def footer_row_count(spark, d):
    n = records.count_rows(spark, f"{d}/documents.parquet", f"{d}/pages.parquet")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query(with_(V.REC) + "SELECT src::BIGINT AS src, count(*) AS n, count(DISTINCT name_core) AS names FROM rec WHERE bucket = 'de' GROUP BY src")
def written_table(spark, d):
    """A partitioned table at its artifact's place, read back with a filter that prunes the other buckets."""
    root = folders.new_folder(spark, "artifacts")
    sinks.write_table(V.records(spark, d).select("entity_id", "src", "name_core", "bucket"), sinks.artifact(root, "normalised", "train"), ["bucket"])
    rows = spark.read.parquet(sinks.artifact(root, "normalised", "train")).where("bucket = 'de'")
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("name_core").alias("names"))


@query(with_(V.REC, V.WORD) + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM word")
def stored_index_search(spark, d):
    """Word retrieval from an index that was written to the shared folder and is kept for the session."""
    refs, cands = (V.words(x) for x in V.sides(spark, d))
    index = folders.stored(spark, "word-index", [f"{d}/documents.parquet"], lambda: blocking.sparse_index(cands))
    return blocking.sparse_search(refs, index)


@query("SELECT 'V-' || vec_id AS id, label::VARCHAR AS bucket, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE vec_id % 3 <> 0")
def embedding_cache(spark, d):
    """Vectors of candidates from a part that is stored with its codes and used again."""
    cands = V.vectors(spark, d)[1]
    part = folders.stored(spark, "vectors", [f"{d}/embeddings.parquet"], lambda: dense.encode(cands, dense.fit_codebooks(cands)))
    return part.select("id", "bucket", F.round(F.aggregate("v", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query("SELECT run, lang, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang), (SELECT unnest(['first', 'second']) AS run)")
def report_runs(spark, d):
    """Counts put into a JSON report twice: both runs are kept."""
    import os
    import tempfile

    counts = {r["lang"]: r["count"] for r in V.read(spark, d, "documents").groupBy("lang").count().collect()}
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "report.json")
        for run in ("first", "second"):
            sinks.merge_report(path, run, {"counts": counts})
        with open(path, encoding="utf-8") as f:
            runs = json.load(f)["runs"]
    return spark.createDataFrame([(run, k, n) for run, x in runs.items() for k, n in x["counts"].items()], "run string, lang string, n long")


@query("SELECT row_number() OVER (ORDER BY lang NULLS FIRST) + 2 AS line, '| ' || coalesce(lang, '') || ' | ' || count(*) || ' |' AS text FROM documents GROUP BY lang UNION ALL SELECT 1, '| lang | n |' UNION ALL SELECT 2, '| --- | --- |'")
def markdown_table(spark, d):
    rows = V.read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    lines = sinks.markdown([r.asDict() for r in rows], ["lang", "n"]).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


@query("SELECT 0.6::DOUBLE AS tau_match, 0.2::DOUBLE AS tau_s, 0.05::DOUBLE AS margin, 0.1::DOUBLE AS boost, 0.7::DOUBLE AS veto")
def resolved_policy(spark, d):
    """Explicit values before stored ones before defaults."""
    p = decision.resolve({"tau_match": 0.6, "tau_s": None}, {"tau_match": 0.1, "tau_s": 0.2}, {"tau_s": 0.9, "veto": 0.7})
    return spark.createDataFrame([(p.tau_match, p.tau_s, p.margin, p.boost, p.veto)], "tau_match double, tau_s double, margin double, boost double, veto double")


@query(with_(V.REC, V.EXACT, V.WORD, "two AS (SELECT ref_id, cand_id, max(score) AS score FROM (SELECT ref_id, cand_id, score FROM exact UNION ALL SELECT ref_id, cand_id, score FROM word) GROUP BY ALL)") + "SELECT ref_id, cand_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS rank FROM two) WHERE rank <= 10")
def topk_merge(spark, d):
    """The ten best of two batches, as the stream merges them."""
    every = linkage.stored_lists(spark, d)
    folder = folders.new_folder(spark, "stream")
    state = topk.TopK(spark, folder, 10, parts=4)
    for n, name in enumerate(("exact", "word")):
        state.add(every.where(F.col("channel") == name).select("ref_id", "cand_id", "score"), n)
    return state.current(1).select("ref_id", "cand_id", "score", "rank")


# projections


@query(with_(V.REC) + r"""SELECT entity_id, CASE doc_id % 4 WHEN 3 THEN 'UNKNOWN' ELSE 'S' || src END AS source, trim(name_core || ' ' || addr_norm) AS retrieval, 'query: ' || name_core || CASE addr_norm WHEN '' THEN '' ELSE ' | ' || addr_norm END AS embedded,
  CASE WHEN len(name_core) = 0 THEN '0' WHEN len(name_core) <= 10 THEN '1-10' WHEN len(name_core) <= 20 THEN '11-20' WHEN len(name_core) <= 40 THEN '21-40' ELSE '41+' END AS length_bucket,
  regexp_extract(name_core || ' inc.', '([\p{L}\p{N}]+)[^\p{L}\p{N}]*$', 1) AS suffix, trim(regexp_replace('  ' || name_core || '  X', '\s+', ' ', 'g')).lower() AS mild,
  CASE doc_id % 5 WHEN 0 THEN CASE WHEN regexp_matches(name_core, '[A-Za-z\x{C0}-\x{24F}]') THEN 'mixed' ELSE 'indic' END WHEN 1 THEN 'indic' WHEN 2 THEN 'empty' WHEN 3 THEN 'other'
    ELSE CASE WHEN regexp_matches(name_core, '[A-Za-z\x{C0}-\x{24F}]') THEN 'latin' WHEN name_core = '' THEN 'empty' ELSE 'other' END END AS profile FROM rec""")
def text_projections(spark, d):
    name, n = F.col("name_core"), F.col("doc_id") % 5
    profiled = F.when(n == 0, F.concat(name, F.lit(" भारत"))).when(n == 1, "தமிழ்").when(n == 2, "").when(n == 3, "12 34").otherwise(name)
    ids = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("X"), "entity_id")).otherwise(F.col("entity_id"))
    return V.records(spark, d).select(
        "entity_id", text.source_of(ids).alias("source"), text.retrieval_text(name, F.col("addr_norm"), True).alias("retrieval"), text.embedding_text("query", name, F.col("addr_norm")).alias("embedded"),
        text.length_bucket(F.length(name)).alias("length_bucket"), text.profile_suffix(F.concat(name, F.lit(" inc."))).alias("suffix"), text.mild(F.concat(F.lit("  "), name, F.lit("  X"))).alias("mild"), text.profile_script(profiled).alias("profile"),
    )


@query(with_(V.REC, V.EXACT) + "SELECT ref_id, CASE WHEN bool_or(cand_id LIKE 'S2-%') AND bool_or(cand_id LIKE 'S3-%') THEN 's2+s3' WHEN bool_or(cand_id LIKE 'S2-%') THEN 's2' ELSE 's3' END AS mix FROM exact GROUP BY ref_id")
def source_composition(spark, d):
    found = blocking.exact_channel(*V.sides(spark, d))
    return found.groupBy("ref_id").agg(text.source_mix(F.collect_set(F.substring("cand_id", 1, 3))).alias("mix"))


#: Codes by the published rules of Metaphone, and Indic words in Latin letters.
SOUNDS = {"philosophy": "FLSF", "wrack": "RK", "school": "SKL", "church": "XRX", "xerxes": "SRKSS", "thumb": "0M", "science": "SNS", "judge": "JJ", "nation": "NXN", "which": "WX", "quick": "KK", "bob": "BB"}
ROMAN = {"भारत": "bharata", "कमल": "kamala", "राम": "rama", "दिल्ली": "dilli", "मुंबई": "mumbai", "plain": "plain"}


def _sample(table: dict[str, str]):
    n = F.pmod(F.col("doc_id"), F.lit(len(table))).cast("int")
    return F.element_at(F.array(*map(F.lit, table)), n + 1)


def _expected(table: dict[str, str]) -> str:
    return f"[{words(table.values())}][doc_id % {len(table)} + 1]"


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'devanagari' WHEN 1 THEN 'tamil' WHEN 2 THEN 'telugu' WHEN 3 THEN 'kannada' ELSE CASE WHEN regexp_matches(text, '[A-\\x{24F}]') THEN 'latin' ELSE 'other' END END AS script FROM documents")
def detect_script_indic(spark, d):
    """Texts that begin with a letter of each Indic script that is told apart, followed by others."""
    n = F.col("doc_id") % 5
    lead = F.when(n == 0, "भ த").when(n == 1, "த భ").when(n == 2, "భ ಕ").when(n == 3, "ಕ भ").otherwise("")
    return V.read(spark, d, "documents").select("doc_id", text.script(F.concat(lead, F.when(n == 4, F.col("text")).otherwise(F.concat(F.lit(" "), "text")))).alias("script"))


RULES = "CASE doc_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'india' ELSE 'france' END"
ENDS = {"us": ["acme corp", "st co", "blue llc"], "india": ["acme pvt ltd", "nr llp", "tata pvt"], "france": ["acme sarl", "st eurl", "bd sa"]}


def _by_rule(values: dict[str, list[str]]):
    n, k = F.col("doc_id") % 3, (F.col("doc_id") % 9 / 3).cast("int")
    pick = lambda name: F.element_at(F.array(*map(F.lit, values[name])), k + 1)
    return F.when(n == 0, pick("us")).when(n == 1, pick("india")).otherwise(pick("france"))


def _rule():
    n = F.col("doc_id") % 3
    return F.when(n == 0, "us").when(n == 1, "india").otherwise("france")


def _rule_sql(values: dict[str, list[str]]) -> str:
    return "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN [{words(values[n])}][(doc_id % 9) // 3 + 1]" for i, n in enumerate(("us", "india", "france"))) + " END"


def _table_sql(name: str, c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lists.ABBREVIATIONS[name].items()) + f" ELSE {c} END"


FORMS = "CASE " + " ".join(f"WHEN rule = '{n}' AND len(w) >= {k} AND array_to_string(w[-{k}:], ' ') IN ({words(lists.LEGAL_SUFFIXES[n])}) THEN array_to_string(w[-{k}:], ' ')" for n in ("us", "india", "france") for k in range(5, 0, -1)) + " ELSE '' END"


@query(with_(V.REC, f"said AS (SELECT entity_id, {RULES} AS rule, string_split(trim(name_core || ' ' || {_rule_sql(ENDS)}), ' ') AS t FROM rec)",
             "ex AS (SELECT entity_id, rule, string_split(array_to_string(CASE rule " + " ".join(f"WHEN '{n}' THEN list_transform(t, lambda x: {_table_sql(n, 'x')})" for n in ("us", "india", "france")) + " END, ' '), ' ') AS w FROM said)")
       + f"SELECT entity_id, array_to_string(w, ' ') AS expanded, s AS suffix, array_to_string(w[1:len(w) - CASE s WHEN '' THEN 0 ELSE len(string_split(s, ' ')) END], ' ') AS core FROM (SELECT *, {FORMS} AS s FROM ex)")
def norm_names_by_country(spark, d):
    """Abbreviations and legal forms by each country's tables."""
    rows = V.records(spark, d).select("entity_id", _rule().alias("rule"), text.tokens(F.trim(F.concat_ws(" ", "name_core", _by_rule(ENDS)))).alias("t"))
    rows = rows.select("entity_id", "rule", text.expand(F.col("t"), F.col("rule")).alias("w"))
    s = text.legal_suffix(F.col("w"), F.col("rule"))
    return rows.select("entity_id", F.array_join("w", " ").alias("expanded"), s.alias("suffix"), F.array_join(text.without_suffix(F.col("w"), s), " ").alias("core"))


PLACES = {"us": ["springfield il 62704", "new york st tx", "reno 12345-6789"], "india": ["pune maharashtra", "agra uttar pradesh", "salem 636001"], "france": ["vannes bretagne", "nancy grand est", "arles 13200"]}
TAIL = "list_filter(list_transform(range(3, 0, -1), lambda n: CASE WHEN len(w) >= n AND (rule = 'france' OR n < 3) THEN array_to_string(w[-n:], ' ') ELSE '' END), lambda x: CASE rule WHEN 'india' THEN x IN ({india}) WHEN 'france' THEN x IN ({france}) ELSE false END)[1]".format(india=words(lists.STATES["india"]), france=words(lists.STATES["france"]))
US_AT = f"list_max(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({words(lists.STATES['us'])})))"
LETTERS = r"'\p{L}+'"
STREETS = words(lists.STREET_TYPES)


@query(with_(V.REC, f"ad AS (SELECT entity_id, {RULES} AS rule, list_filter(string_split(addr_norm || ' ' || {_rule_sql(PLACES)}, ' '), lambda t: t <> '') AS w FROM rec)", f"st AS (SELECT *, {TAIL} AS tail, CASE rule WHEN 'us' THEN {US_AT} END AS i FROM ad)")
       + rf"""SELECT entity_id, CASE WHEN i > 1 THEN w[i] ELSE coalesce(tail, '') END AS state,
  CASE WHEN i > 1 THEN CASE WHEN NOT regexp_full_match(w[i - 1], {LETTERS}) OR w[i - 1] IN ({STREETS}) THEN '' WHEN i > 2 AND regexp_full_match(w[i - 2], {LETTERS}) AND w[i - 2] NOT IN ({STREETS}) THEN w[i - 2] || ' ' || w[i - 1] ELSE w[i - 1] END
    ELSE coalesce(list_filter(w[1:len(w) - CASE WHEN tail IS NULL THEN 0 ELSE len(string_split(tail, ' ')) END], lambda t: regexp_full_match(t, {LETTERS}))[-1], '') END AS city,
  coalesce(CASE rule """ + " ".join(f"WHEN '{n}' THEN regexp_extract_all(array_to_string(w, ' '), '{p}')[-1]" for n, p in lists.POSTAL.items()) + " END, '') AS postal FROM st")
def addr_by_country(spark, d):
    """State, city and postal code by each country's rule."""
    rows = V.records(spark, d).select("entity_id", _rule().alias("rule"), text.tokens(F.concat_ws(" ", "addr_norm", _by_rule(PLACES))).alias("w"))
    rows = rows.select("entity_id", "rule", "w", address.place(F.col("w"), F.col("rule")).alias("p"))
    return rows.select("entity_id", "p.state", "p.city", address.postal(F.array_join("w", " "), F.col("rule")).alias("postal"))


@query(with_(V.REC) + r"SELECT entity_id, coalesce(list_filter(range(1, len(w)), lambda i: w[i] = code AND regexp_full_match(w[i + 1], '\p{L}+')).list_transform(lambda i: w[i + 1])[1], '') AS city FROM (SELECT entity_id, (10000 + doc_id)::VARCHAR AS code, list_filter(string_split(addr_norm, ' '), lambda t: t <> '') || [(10000 + doc_id)::VARCHAR, CASE doc_id % 2 WHEN 0 THEN 'lyon' ELSE '12' END] AS w FROM rec)")
def addr_city_after_postal(spark, d):
    code = (10000 + F.col("doc_id")).cast("string")
    w = F.concat(text.tokens(F.col("addr_norm")), F.array(code, F.when(F.col("doc_id") % 2 == 0, "lyon").otherwise("12")))
    return V.records(spark, d).select("entity_id", address.city_after_postal(w, code).alias("city"))


SUFFIX = "CASE doc_id % 4 WHEN 0 THEN ' private limited' WHEN 1 THEN ' llc' WHEN 2 THEN ' co x' ELSE '' END"
FORM_WORDS = "'private', 'limited', 'ltd', 'pvt', 'llp', 'llc', 'inc', 'incorporated', 'corp', 'corporation', 'co', 'company', 'praiveta', 'limiteda', 'praivet', 'pra', 'li', 'elaelapi', 'elelbhi', 'elelpi'"
NOISE = "'near', 'opp', 'opposite', 'road', 'rd', 'street', 'st', 'lane', 'marg', 'nagar', 'colony', 'sector', 'block', 'phase', 'district', 'dist', 'pin', 'floor', 'building', 'bldg', 'plot', 'flat', 'no', 'behind', 'beside', 'circle', 'chowk', 'cross', 'main', 'industrial', 'area', 'estate', 'complex', 'tower', 'bazaar', 'market', 'post', 'taluk', 'tehsil'"


@query(with_(V.REC) + rf"""SELECT entity_id, array_to_string(list_filter(string_split(strip_accents(name_core) || {SUFFIX}, ' '), lambda t: len(t) >= 2 AND t NOT IN ({FORM_WORDS})), ' ') AS core,
  array_to_string(list_filter(string_split(strip_accents(addr_norm) || ' main road 12 x', ' '), lambda t: len(t) >= 2 AND t NOT IN ({NOISE}) AND NOT regexp_full_match(t, '\p{{Nd}}+')), ' ') AS addr_core FROM rec""")
def phonetic_cores(spark, d):
    """Names without legal forms and addresses without common words, which phonetic keys are made from."""
    n = F.col("doc_id") % 4
    tail = F.when(n == 0, " private limited").when(n == 1, " llc").when(n == 2, " co x").otherwise("")
    rows = V.records(spark, d).select("entity_id", F.concat(arrow.without_accents(F.col("name_core")), tail).alias("n"), F.concat(arrow.without_accents(F.col("addr_norm")), F.lit(" main road 12 x")).alias("a"))
    return blocking.phonetic_columns(rows, "n", "a").select("entity_id", "core", "addr_core")


@query(f"SELECT doc_id, {_expected(SOUNDS)} AS code FROM documents")
def metaphone_samples(spark, d):
    return V.read(spark, d, "documents").select("doc_id", arrow.metaphone_key(_sample(SOUNDS)).alias("code"))


@query(f"SELECT doc_id, {_expected(ROMAN)} AS latin FROM documents")
def romanised_samples(spark, d):
    return V.read(spark, d, "documents").select("doc_id", arrow.romanized(_sample(ROMAN)).alias("latin"))


NORMALISED_CHARS = {"ﬁne": "fine", "Ⅳ": "IV", "①": "1", "ｶﾞ": "ガ", "²x": "2x", "plain": "plain"}


@query(f"SELECT doc_id, {_expected(NORMALISED_CHARS)} AS nfkc FROM documents")
def norm_nfkc(spark, d):
    return V.read(spark, d, "documents").select("doc_id", arrow.nfkc(_sample(NORMALISED_CHARS)).alias("nfkc"))
