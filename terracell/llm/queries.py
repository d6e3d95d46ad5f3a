"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracell.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op01_token_orc as op
    from terracell.llm.common import shared_path

    path = shared_path(spark, "tokens")
    op.write(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return op.digests(op.with_starts(spark, path))


def op2_kneser_ney_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op02_kneser_ney_lang as op
    from terracell.llm.common import id_crc

    docs = documents(spark, sf_dir)
    rows = op.identify(docs, op.fit(docs)).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op03_host_quality as op

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return op.judge(documents(spark, sf_dir)).select(*columns)


#: A page's host, and its words outside of tags.
PAGE_HOST, PAGE_TEXT = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)", "regexp_replace(html, '<[^>]*>', ' ')"
PAGE_HOST_SQL, PAGE_TEXT_SQL = PAGE_HOST, PAGE_TEXT.replace("' ')", "' ', 'g')")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over raw pages: the verdict of each host."""
    from pyspark.sql import functions as F

    from terracell.llm import op03_host_quality as op

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.expr(PAGE_HOST).alias("source"), F.expr(PAGE_TEXT).alias("text"))
    return op.host_verdicts(op.measure(pages)).select("host", "n_docs", "host_bad")


def op4_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op04_media_tiles as op

    return op.text_digests(documents(spark, sf_dir))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terracell.llm import op05_prefix_bpe as op

    return op.digests(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from terracell.llm import op06_bounded_ring as op

    rows = op.assign(documents(spark, sf_dir), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op07_best_fit_packing as op

    return op.pack(documents(spark, sf_dir))


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from terracell.llm import op08_nbsvm_quality as op
    from terracell.llm.common import id_crc

    docs = documents(spark, sf_dir)
    rows = op.classify(docs, op.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_hashed_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op09_hashed_maxent_lm as op

    return op.score(documents(spark, sf_dir))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op10_circulant_minhash as op

    return op.groups(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op11_merkle_manifest as op

    return op.manifest(documents(spark, sf_dir))


def op12_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op12_prefix_tree_join as op

    return op.joined(documents(spark, sf_dir))


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracell.llm import op13_threshold_search as op

    return op.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, by name."""
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()] + [page_hosts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    documents_ = OP3_SQL.format(id="doc_id", host="source", text="text", table="documents")
    pages_ = OP3_SQL.format(id="page_id", host=PAGE_HOST_SQL, text=PAGE_TEXT_SQL, table="pages")
    pages_ = pages_[: pages_.rindex("SELECT * EXCLUDE")] + "SELECT host, n_docs::BIGINT AS n_docs, host_bad FROM hv"
    return {"op3_host_quality": documents_, "page_hosts": pages_, "op10_circulant_minhash": OP10_SQL, "op11_merkle_manifest": _merkle_sql(), "op12_prefix_tree_join": OP12_SQL, "op13_threshold_search": OP13_SQL}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '')"

def _hosts_sql() -> str:
    """CTEs from measures `m` to `judged`: rule failures by host, each host's posterior against the other hosts' rate, the verdict."""
    from terracell.llm import op03_host_quality as op

    fail = " UNION ALL ".join(f"SELECT host, '{name}' AS rule, count(*) AS n, sum(({rule})::INT)::DOUBLE AS f FROM based WHERE host IS NOT NULL GROUP BY host" for name, rule in op.RULES.items())
    return f"""based AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m), hf AS ({fail}),
ht AS (SELECT *, count(*) OVER w - 1 AS k, sum(n) OVER w - n AS on_, sum(f) OVER w - f AS of_, sum(n::DOUBLE * n) OVER w - n::DOUBLE * n AS sq, sum(f * f / n) OVER w - f * f / n AS sp FROM hf WINDOW w AS (PARTITION BY rule)),
ho AS (SELECT *, CASE WHEN k = 0 THEN f / n ELSE of_ / on_ END AS mean, CASE WHEN k >= 2 AND of_ > 0 AND of_ < on_ AND on_ - sq / on_ > k - 1 THEN (sp - of_ * of_ / on_) / (of_ / on_ * (1 - of_ / on_)) - (k - 1) END AS excess FROM ht),
hw AS (SELECT *, CASE WHEN excess IS NULL THEN {op.LEAST_WEIGHT} WHEN excess <= 0 THEN {op.MOST_WEIGHT} ELSE least({op.MOST_WEIGHT}, greatest({op.LEAST_WEIGHT}, (on_ - sq / on_ - (k - 1)) / excess - 1)) END AS w FROM ho),
hp AS (SELECT host, n, mean, w, (f + w * mean) / (n + w) AS r FROM hw),
hv AS (SELECT host, any_value(n) AS n_docs, bool_or(n >= {op.LEAST_DOCS} AND (r > {op.WORST_RATE} OR r - {op.DEVIATIONS} * sqrt(r * (1 - r) / (n + w + 1)) > least({op.WORST_RATE}, greatest({op.LEAST_RATE}, {op.ODDS} * mean / (1 + ({op.ODDS} - 1) * mean))))) AS host_bad FROM hp GROUP BY host),
judged AS (SELECT b.*, coalesce(host_bad, false) AS host_bad FROM based b LEFT JOIN hv USING (host))"""


#: Measures, host verdicts by all rules, and the verdicts joined back; repeats are found by grouping all windows.
OP3_SQL = rf"""
WITH d AS (SELECT {{id}} AS doc_id, {{host}} AS host, coalesce({{text}}, '') AS t, {_WORDS.replace("text", "{text}")} AS w, list_filter(string_split(coalesce({{text}}, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\x0C\r]')) AS l FROM {{table}}),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\x0C\r]+', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
, len(l)::BIGINT AS n_lines, host FROM d LEFT JOIN c USING (doc_id)),
{_hosts_sql()}
SELECT * EXCLUDE (host, n_lines, host_bad), NOT base_failed AND NOT host_bad AS kept FROM judged
"""

def _merkle_sql(levels: int = 8) -> str:
    """Leaves, runs of 16 up to `levels` levels in each source and again over the sources' roots, and each leaf's way up them; a level of one node stays as it is."""
    value = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": "text"}
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(**other: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in (value | other).values()) + ")"

    def climb(name: str) -> list[str]:
        """{name}0 (k, pos, d) to {name}{levels}; {name}r{i}: runs of level i, empty where one node was left."""
        out = []
        for i in range(levels):
            out.append(f"{name}r{i} AS (SELECT k, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN string_agg(d, '' ORDER BY pos) ELSE '' END AS s, min(d) AS one FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {name}{i}) GROUP BY ALL)")
            out.append(f"{name}{i + 1} AS (SELECT k, pos, CASE WHEN s = '' THEN one ELSE sha256(s) END AS d FROM {name}r{i})")
        return out

    ways, proof = [], []
    for name, key, place in (("a", "src", "pos"), ("b", "0", "src")):
        for i in range(levels):
            own = f"{name}{i}s[64 * ({place} // {16**i} % 16) + 1:64 * ({place} // {16**i} % 16) + 64]"
            ways.append((f"{name}{i}s", f"{name}{i}s[:64 * ({place} // {16**i} % 16)]", f"{name}{i}s[64 * ({place} // {16**i} % 16) + 65:]", own))
            proof += [ways[-1][1], ways[-1][2]]
    joins = " ".join(f"JOIN ar{i} ON ar{i}.k = l.src AND ar{i}.pos = l.pos // {16 ** (i + 1)} JOIN br{i} ON br{i}.pos = l.src // {16 ** (i + 1)}" for i in range(levels))
    runs = ", ".join(f"ar{i}.s AS a{i}s, br{i}.s AS b{i}s" for i in range(levels))
    folded = "SELECT *, CASE WHEN crc % 5 = 0 THEN changed ELSE d END AS f FROM w"
    for s, left, right, _ in ways:
        folded = f"SELECT * REPLACE (CASE WHEN {s} = '' THEN f ELSE sha256({left} || f || {right}) END AS f) FROM ({folded})"
    return f"""WITH RECURSIVE bytes AS (SELECT doc_id, {leaf()} AS d, {leaf(text=lower)} AS changed, source FROM documents),
crcs AS (SELECT doc_id, x AS crc FROM ({_CRC_SQL})),
l AS (SELECT bytes.*, crc, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM bytes LEFT JOIN crcs USING (doc_id)),
a0 AS (SELECT src AS k, pos, d FROM l), {", ".join(climb("a"))},
b0 AS (SELECT 0 AS k, k AS pos, d FROM a{levels}), {", ".join(climb("b"))},
w AS (SELECT l.*, a{levels}.d AS subroot, b{levels}.d AS root, {runs} FROM l JOIN a{levels} ON a{levels}.k = l.src, b{levels} {joins}),
g AS ({folded})
SELECT doc_id, d AS leaf, subroot, root, sha256({" || ".join(proof)}) AS proof_sha256, f AS folded_root, f = root AS verified FROM g"""


#: crc32 of the decimal id: eight shifts for each character, by the reflected polynomial.
_CRC_SQL = """WITH RECURSIVE c(doc_id, t, i, x) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents UNION ALL
 SELECT doc_id, t, i + 1, y FROM (SELECT doc_id, t, i, CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END AS y FROM (SELECT doc_id, t, i, CASE WHEN i % 8 = 0 THEN xor(x, ascii(t[i // 8 + 1])::BIGINT) ELSE x END AS z FROM c WHERE i < 8 * length(t))))
SELECT doc_id, xor(x, 4294967295) AS x FROM c WHERE i = 8 * length(t)"""


#: All pairs that share a shingle, exact similarities, and the closure of the links.
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
k AS (SELECT s.* FROM s JOIN c USING (g)),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM k a JOIN k b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, a FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

#: The same for 3-word shingles from 90.
OP12_SQL = OP10_SQL.replace("len(w) < 5", "len(w) < 3").replace("len(w) - 3)", "len(w) - 1)").replace("w[i:i + 4]", "w[i:i + 2]").replace(">= 85 *", ">= 90 *").replace(" AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept", " AS component_id")

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every document's score for every item with which it shares a term.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark),
u AS (SELECT DISTINCT t FROM q),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) JOIN u USING (t) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t),
i AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all)) AS i FROM p, c),
s AS (SELECT item_id, doc_id, sum(w * i)::BIGINT AS score FROM q JOIN i USING (t) JOIN f USING (t) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
