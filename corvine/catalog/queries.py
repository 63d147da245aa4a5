"""One query for each operator or family of operators, over whole tables.

documents are the corpus (source_path := source/doc_id, title := lang, tags := lang and source), benchmark items are
the questions; a question expects the documents that hold it verbatim, and is unanswerable if none does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.config import PromptSettings, RetrievalSettings
from corvine.functions import identity
from corvine.functions import text as tx
from corvine.operators import answer, bm25, chunking, containment, context, dense, fusion, ranks
from corvine.operators.filters import build_filter
from corvine.plans import checks, evaluate, ingest, stats
from corvine.plans.results import ResultTable
from corvine.plans.retrieve import Corpus, answer_batch, branches, reranked, retrieve, with_payload
from corvine.runtime import materialize, scratch_root, table
from corvine.sources import points as pt
from corvine.sources.postings import PostingIndex

PAYLOAD = ["source_path", "title", "heading_path", "text"]
#: Languages for which an effect is simulated; more raise an error.
MAX_GROUPS = 1000


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"),
        F.col("lang").alias("title"), F.lit(None).cast("string").alias("heading_path"), F.array("lang", "source").alias("tags"))


def corpus(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(docs(spark, sf), "doc_id")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokenize_terms(spark, sf):
    t = docs(spark, sf).select("doc_id", tx.search_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("terms_sha256"))


def term_hash(spark, sf):
    t = questions(spark, sf).select(F.explode(tx.search_terms(F.col("text"))).alias("term")).distinct()
    return t.select("term", identity.term_index(F.col("term")).alias("term_idx"))


def bm25_corpus_stats(spark, sf):
    t = corpus(spark, sf).tokenised()
    return bm25.corpus_stats(t).crossJoin(F.broadcast(bm25.vocabulary_size(t))).withColumn("average_length", F.round("average_length", 6))


def bm25_document_weights(spark, sf):
    w = bm25.document_weights(corpus(spark, sf).tokenised(), "doc_id")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def sparse_vectors(spark, sf):
    t = questions(spark, sf).withColumnRenamed("query_id", "item_id")
    v = bm25.sparse_vectors(bm25.document_weights(bm25.with_terms(t, "item_id"), "item_id"), "item_id")
    return v.select("item_id", "indices", F.transform("values", lambda x: F.round(x, 6)).alias("weights"))


def sparse_search_topk(spark, sf):
    hits = bm25.sparse_search(corpus(spark, sf).tokenised(), "doc_id", questions(spark, sf), "query_id", 10)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _index(spark, sf):
    """The documents in a posting index, added in two batches."""
    index = PostingIndex(spark, f"{scratch_root(spark)}/postings-{uuid.uuid4().hex}")
    early = F.coalesce(F.col("source") < "src5", F.lit(False))
    for number, part in enumerate((early, ~early)):
        index.add(docs(spark, sf).where(part), number)
    return index


def posting_search_topk(spark, sf):
    hits = _index(spark, sf).search(questions(spark, sf), "query_id", 10)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def posting_statistics(spark, sf):
    """Document frequency of every term, and the document count under a null term, from stored batches."""
    index = _index(spark, sf)
    return index.document_frequencies().unionByName(index.corpus_stats().select(F.lit(None).cast("string").alias("term"), F.col("document_count").alias("df")))


def fake_embedding_vectors(spark, sf):
    v = docs(spark, sf).select("doc_id", F.posexplode(identity.hash_vector(F.col("text"))).alias("dim", "x"))
    return v.select("doc_id", "dim", F.round("x", 6).alias("x"))


def _vector_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def dense_knn_cosine(spark, sf):
    """Queries: every vector whose id is divisible by 100, against all vectors."""
    e, q = _vector_queries(spark, sf)
    hits = dense.dense_search(e.withColumnRenamed("embedding", "vector"), "vec_id", q, "query_id", 10)
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def dense_knn_label_recall(spark, sf):
    e, q = _vector_queries(spark, sf)
    hits = dense.dense_search(e.withColumnRenamed("embedding", "vector"), "vec_id", q, "query_id", 11).where("query_id <> vec_id")
    same = hits.join(e.select("vec_id", "label"), "vec_id").join(F.broadcast(q.select("query_id", "query_label")), "query_id")
    return same.groupBy("query_label").agg(F.count("*").alias("neighbours"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("label_share"))


def _hybrid(spark, sf, flt=None, **how):
    return retrieve(corpus(spark, sf), questions(spark, sf), settings=RetrievalSettings(**how), flt=flt)


def hybrid_rrf_fusion(spark, sf):
    h = _hybrid(spark, sf)
    return h.select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"), F.col("ranks")["dense"].alias("dense_rank"), F.col("ranks")["sparse"].alias("sparse_rank"))


def hybrid_filtered(spark, sf):
    flt = build_filter({"source": ["src1", "src2"], "tags": ["en", "fr"]})
    h = _hybrid(spark, sf, flt)
    return h.select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def hybrid_zero_weight_branch(spark, sf):
    h = _hybrid(spark, sf, weights={"dense": 0.0, "sparse": 1.0})
    return h.select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"), F.col("ranks")["dense"].alias("dense_rank"))


def score_threshold_dropped(spark, sf):
    s = RetrievalSettings()
    fused = fusion.fuse(branches(corpus(spark, sf), questions(spark, sf), "query_id", s), "query_id", "doc_id")
    hits, dropped = fusion.threshold_and_limit(fused, "query_id", 60, 0.0125)
    return dropped.join(hits.groupBy("query_id").agg(F.count("*").alias("kept")), "query_id", "left").select("query_id", "dropped", F.coalesce("kept", F.lit(0)).alias("kept"))


def branch_contribution(spark, sf):
    h = _hybrid(spark, sf).withColumn("branch", fusion.branch_label(F.col("ranks")))
    return h.groupBy("branch").agg(F.count("*").alias("hits"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def rerank_term_coverage(spark, sf):
    c, q = corpus(spark, sf), questions(spark, sf)
    h = with_payload(retrieve(c, q, depth=40), c, ["text"])
    out = reranked(h, q, "query_id", "fake", 6)
    return out.select("query_id", "doc_id", "rank", "pre_rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


def _prompt_hits(spark, sf, mode="sparse"):
    c, q = corpus(spark, sf), questions(spark, sf)
    h = with_payload(retrieve(c, q, settings=RetrievalSettings(mode=mode)), c, PAYLOAD).withColumn("key", F.col("doc_id"))
    return h, q


def context_budget_blocks(spark, sf):
    h, _ = _prompt_hits(spark, sf)
    b = context.select_blocks(h, "query_id", 8, 1500)
    return b.select("query_id", "dropped", "tokens", F.posexplode("blocks").alias("pos", "b")).select("query_id", "dropped", "tokens", "b.marker", F.col("b.key").alias("doc_id"), "b.rank")


def prompt_render(spark, sf):
    h, q = _prompt_hits(spark, sf)
    a = answer_batch(h, q, "query_id")
    return a.select("query_id", F.length("prompt").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def extractive_answer(spark, sf):
    h, q = _prompt_hits(spark, sf)
    return answer_batch(h, q, "query_id").select("query_id", "answer", "refused", "hits_used")


def cached_answers(spark, sf):
    """Answers by way of a result table: the second pass over the same questions reads results alone."""
    t = ResultTable(spark, f"{scratch_root(spark)}/results-{uuid.uuid4().hex}", "answer string, refused boolean, hits_used int")
    digest = identity.cache_digest(F.col("text"), F.lit(checks.retrieval_fingerprint(mode="sparse", top_k=12)))

    def answer(new):
        c, q = corpus(spark, sf), new.withColumnRenamed("digest", "query_id")
        h = with_payload(retrieve(c, q, settings=RetrievalSettings(mode="sparse")), c, PAYLOAD).withColumn("key", F.col("doc_id"))
        return answer_batch(h, q, "query_id").withColumnRenamed("query_id", "digest")

    q = questions(spark, sf)
    t.answered(q, "query_id", digest, answer)
    return t.answered(q, "query_id", digest, answer)


def refusal_reasons(spark, sf):
    h, q = _prompt_hits(spark, sf, "dense")
    r = answer_batch(h.where("split_part(source_path, '/', 1) in ('src0', 'src1')"), q, "query_id", PromptSettings(max_blocks=2))
    return r.groupBy(F.coalesce("refusal_reason", F.lit("answered")).alias("reason")).agg(F.count("*").alias("questions"))


def citation_markers(spark, sf):
    """Markers written behind conversation texts, resolved against three blocks."""
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    said = c.withColumn("answer", F.concat("text", F.lit(" ["), (F.col("turn") % 5).cast("string"), F.lit(", 2] and [ 9;1 ] .")))
    blocks = F.array(*[F.struct(F.lit(i).alias("marker")) for i in (1, 2, 3)])
    out = answer.cited(said.withColumn("blocks", blocks))
    return out.select("conv_id", "turn", F.array_join("cited", ",").alias("cited"), F.array_join("invalid_markers", ",").alias("invalid"), F.sha2("answer", 256).alias("answer_sha256"))


def uncited_sentences(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    u = c.select("conv_id", "turn", tx.uncited_claims(F.col("text")).alias("u"))
    return u.select("conv_id", "turn", F.size("u").alias("n"), F.sha2(F.array_join("u", "|"), 256).alias("claims_sha256"))


def judge_overlap(spark, sf):
    """Each assistant turn judged as the answer to the turn before it, with that turn as its context too."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    both = c.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    f, r = answer.judge(F.col("question"), F.col("text"), F.array("question"), F.lit(False))
    return both.select("conv_id", "turn", f.alias("faithfulness"), r.alias("relevance"))


def judge_reply_scores(spark, sf):
    e = table(spark, sf, "events")
    reply = F.concat(F.lit("scores: {\"faithfulness\": "), F.round("value", 3).cast("string"), F.lit(", \"relevance\": "), F.when(F.col("event_id") % 3 == 0, "\"high\"").otherwise((F.col("event_id") % 7 / 4 - 0.5).cast("string")), F.lit("} end"))
    f, r = answer.parse_judge_reply(F.when(F.col("event_id") % 11 == 0, "no object").otherwise(reply))
    return e.select("event_id", f.alias("faithfulness"), r.alias("relevance"))


def _cases(spark, sf):
    """Items with the documents that hold them verbatim."""
    q = questions(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    pairs = containment.holding(docs(spark, sf).select("doc_id", F.col("text").alias("body")), "doc_id", "body", q, "query_id", "text")
    expected = pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected"))
    c = q.join(expected, "query_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<bigint>")))
    n = F.size("expected")
    return c.select(F.col("query_id").alias("id"), "text", "expected", F.when(n == 0, "unanswerable").when(n == 1, "single").otherwise("multi").alias("category"), F.lit(None).cast("boolean").alias("answerable"))


def golden_labels(spark, sf):
    return _cases(spark, sf).select("id", "category", F.size("expected").alias("n_expected"), F.array_join("expected", ",").alias("expected"))


def case_predicates(spark, sf):
    c = _cases(spark, sf).withColumn("answerable", F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0))
    return c.select("id", evaluate.scorable().alias("scorable"), evaluate.unanswerable().alias("unanswerable"))


def _tier1(spark, sf, mode="sparse", k=5):
    cases = materialize(_cases(spark, sf), "cases")
    hits = retrieve(corpus(spark, sf), questions(spark, sf), settings=RetrievalSettings(mode=mode, top_k=k)).withColumnRenamed("query_id", "id")
    return evaluate.tier1_cases(cases, hits, "doc_id")


def tier1_per_case(spark, sf):
    return _tier1(spark, sf).select("id", "scored", "hit", "hit_rank", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def tier1_by_category(spark, sf):
    return evaluate.by_category(_tier1(spark, sf)).select(F.col("overall").cast("int").alias("overall"), F.coalesce("category", F.lit("all")).alias("category"), "cases", "hit_at_k", "recall_at_k")


def hit_at_several_k(spark, sf):
    c = _tier1(spark, sf, k=10).where("scored")
    return c.agg(*[F.round(F.avg((F.coalesce("hit_rank", F.lit(99)) <= k).cast("double")), 6).alias(f"hit_at_{k}") for k in (1, 3, 5, 10)])


def _tier2(spark, sf, mode="sparse"):
    h, q = _prompt_hits(spark, sf, mode)
    cases = materialize(_cases(spark, sf), "cases")
    a = answer_batch(h, q, "query_id").withColumnRenamed("query_id", "id")
    return evaluate.tier2_cases(cases, a.select("id", "answer", "blocks", "cited", "invalid_markers", "refused"))


def tier2_per_case(spark, sf):
    return _tier2(spark, sf).select("id", "citation_precision", "citations", "refused", "refusal_correct", "faithfulness", "relevance")


def tier2_aggregates(spark, sf):
    return evaluate.tier2_metrics(_tier2(spark, sf))


def _ablation(spark, sf, k=5):
    """Case rows of all four configurations. The two branches run once and are written; each configuration fuses those."""
    c, q = corpus(spark, sf), questions(spark, sf)
    cases = materialize(_cases(spark, sf), "cases")
    found = {b: materialize(r, b) for b, r in branches(c, q, "query_id", RetrievalSettings()).items()}
    fused = {m: fusion.fuse({b: r for b, r in found.items() if m in (b, "hybrid")}, "query_id", "doc_id") for m in ("sparse", "dense", "hybrid")}
    fused["hybrid"] = materialize(fused["hybrid"], "hybrid")
    parts = None
    for name, (mode, rerank_kind) in evaluate.CONFIGURATIONS.items():
        hits = fused[mode].withColumn("rank", F.col("fused_rank"))
        if rerank_kind != "off":
            hits = reranked(with_payload(hits.where("rank <= 40"), c, ["text"]), q, "query_id", rerank_kind, k)
        part = hits.where(F.col("rank") <= k).select(F.col("query_id").alias("id"), "doc_id", "rank", F.lit(name).alias("config"))
        parts = part if parts is None else parts.unionByName(part)
    grid = cases.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in evaluate.CONFIGURATIONS], "config string")))
    return materialize(evaluate.tier1_cases(grid, parts, "doc_id", ["config"]), "ablation")


def ablation_modes(spark, sf):
    return evaluate.tier1_metrics(_ablation(spark, sf), ["config"])


def _pairs(spark, sf):
    """Binary outcomes in pairs, by language: a document's two quality marks from labels."""
    labels = table(spark, sf, "labels").where("quality is not null and toxic is not null")
    return labels.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))


def paired_delta_mcnemar(spark, sf):
    p = stats.paired(_pairs(spark, sf), ["lang"])
    return p.select("lang", "n", F.round("delta", 6).alias("delta"), "a_only", "b_only", F.round("p_exact", 9).alias("p_exact"))


def reportability(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    e = e.withColumn("low", F.col("low") - F.col("user_id") % 3 * 10)
    ok, why = stats.reportable(F.col("n"), F.col("low"), F.col("high"))
    return e.select("user_id", "n", ok.alias("reportable"), why.alias("reason"))


def bootstrap_ci(spark, sf):
    return stats.bootstrap(_pairs(spark, sf), ["lang"], "doc_id")


def scorecard_comparisons(spark, sf):
    return evaluate.comparisons(_ablation(spark, sf))


def mde(spark, sf):
    """The effect for every language, null included; each is a simulation of its own, so too many of them are an error."""
    rates = _pairs(spark, sf).groupBy("lang").agg(F.avg(F.col("a").cast("double")).alias("rate")).orderBy("lang").limit(MAX_GROUPS + 1).collect()
    if len(rates) > MAX_GROUPS:
        raise ValueError(f"mde: more than {MAX_GROUPS} languages")
    return spark.createDataFrame([(r["lang"], stats.minimum_detectable_effect(spark, 60, r["rate"])) for r in rates], "lang string, mde double")


def _chunks(spark, sf):
    return docs(spark, sf).select("source_path", F.lit(0).alias("chunk_index"), "text", "title")


def doc_chunk_point_ids(spark, sf):
    d, sha = identity.doc_id(F.col("source_path")), identity.sha256_text(F.col("text"))
    return _chunks(spark, sf).select("source_path", d.alias("doc_id"), identity.chunk_id(d, F.col("chunk_index")).alias("chunk_id"), sha.alias("content_sha256"), identity.point_id(F.col("source_path"), F.col("chunk_index"), sha).alias("point_id"))


def embed_text(spark, sf):
    c = docs(spark, sf).select("doc_id", F.sha2(tx.embed_text(F.col("text"), F.col("title"), F.array("source", "lang")), 256).alias("embed_sha256"))
    return c


def token_estimates(spark, sf):
    return docs(spark, sf).select("doc_id", tx.chunk_token_estimate(F.col("text")).alias("chunk_tokens"), tx.prompt_token_estimate(F.col("text")).alias("prompt_tokens"))


def path_functions(spark, sf):
    p = docs(spark, sf).select("doc_id", F.concat(F.lit("/././"), F.replace("source_path", F.lit("/"), F.lit("\\"))).alias("p"))
    n = tx.normal_path(F.col("p"))
    return p.select("doc_id", n.alias("path"), tx.source_of(n).alias("source"))


def headings_and_tags(spark, sf):
    """First level-one heading of page texts made Markdown, and tags from comma lists."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<h1[^>]*>", "\n# "), "</h1>", " #\n").alias("md"), F.regexp_replace(F.coalesce("url", F.lit("")), "[/.?=&#:-]", ", ").alias("t"))
    return p.select("page_id", tx.first_h1(F.col("md")).alias("h1"), F.array_join(tx.tag_list(F.col("t")), "|").alias("tags"))


def comments_stripped(spark, sf):
    p = table(spark, sf, "pages").select("page_id", tx.without_comments(F.coalesce("html", F.lit(""))).alias("x"))
    return p.select("page_id", F.length("x").alias("n_chars"), F.sha2("x", 256).alias("sha256"))


def stream_pieces(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.stream_pieces(F.coalesce("text", F.lit(""))).alias("p"))
    return c.select("conv_id", "turn", F.size("p").alias("pieces"), F.sha2(F.array_join("p", ""), 256).alias("text_sha256"))


def first_cited_sentences(spark, sf):
    s = tx.first_sentence(F.col("text"))
    return docs(spark, sf).select("doc_id", F.when(s != "", tx.cite(s, F.lit(3))).alias("cited"))


def filter_predicates(spark, sf):
    flt = build_filter({"source": [" src3", "src4"], "tags": "de"})
    return flt.apply(docs(spark, sf)).select("doc_id", "source", "lang")


def _versions(spark, sf):
    """Points of all documents, and all of them again under other ids, half of which are known, with other contents."""
    old = docs(spark, sf).select(F.col("doc_id").alias("point_id"), "source", F.sha2("text", 256).alias("content"))
    return old, old.select((F.col("point_id") * 2).alias("point_id"), "source", F.concat("content", F.lit("-new")).alias("content"))


def incremental_anti_join(spark, sf):
    old, new = _versions(spark, sf)
    return pt.fresh_points(old, new)


def upsert_merge(spark, sf):
    """Through a stored table: both writes touch only the buckets of their ids."""
    t = pt.PointsTable(spark, f"{scratch_root(spark)}/points-{uuid.uuid4().hex}")
    t.ensure(1, sparse=False, buckets=8)
    for points in _versions(spark, sf):
        t.upsert(points.withColumn("vector", F.array(F.lit(1.0))))
    return t.read().drop("vector")


def existing_point_ids(spark, sf):
    old, new = _versions(spark, sf)
    return pt.existing_ids(old, new)


def point_count(spark, sf):
    return docs(spark, sf).agg(F.count("*").alias("points"))


def embedder_models(spark, sf):
    d = docs(spark, sf).withColumn("embedded_model", F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 < 4, F.concat(F.lit("model-"), "lang")))
    return pt.embedder_models(d)


def corpus_identity_hash(spark, sf):
    return identity.corpus_hash(docs(spark, sf))


def identities_compatible(spark, sf):
    d = docs(spark, sf).select("source", "lang")
    a = d.groupBy("source").agg(F.count("*").alias("doc_count"), F.min("lang").alias("embedder_id"))
    b = a.select(F.col("source").alias("other"), F.col("doc_count").alias("n2"), F.col("embedder_id").alias("e2"))
    j = a.join(b, (F.col("embedder_id").eqNullSafe(F.col("e2"))) & (F.col("source") < F.col("other")))
    return j.select("source", "other", F.col("doc_count").eqNullSafe(F.col("n2")).alias("compatible"))


def cache_key_digest(spark, sf):
    filters = checks.canonical_filters({"tags": ["fr", "en"], "source": "src1"})
    f = checks.retrieval_fingerprint(mode="hybrid", top_k=12, dense_top_k=40, sparse_top_k=40, rrf_k=60)
    fields = [F.lit("points"), F.col("text"), F.lit(filters), F.lit(identity.HASH_MODEL), F.lit("fake"), F.lit(f), F.lit("")]
    return questions(spark, sf).select("query_id", identity.cache_digest(*fields).alias("digest"))


def _golden(spark, sf):
    """A golden set with flaws: repeated ids and questions, sources that are missing or too short to be chunked."""
    q = questions(spark, sf)
    slices = F.array(*map(F.lit, checks.SLICES))
    path = F.concat(F.lit("src"), (F.col("query_id") % 25).cast("string"), F.lit("/"), F.col("query_id").cast("string"))
    return q.select(
        F.concat(F.lit("q"), (F.col("query_id") - F.when(F.col("query_id") % 9 == 8, 1).otherwise(0)).cast("string")).alias("id"), F.when(F.col("query_id") % 10 == 9, "same question").otherwise(F.col("text")).alias("question"),
        F.when(F.col("query_id") % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(path)).alias("expected_source_paths"),
        F.get(slices, (F.col("query_id") % 4).cast("int")).alias("category"), F.when(F.col("query_id") % 4 == 1, False).when(F.col("query_id") % 8 == 0, True).alias("answerable"),
        F.when(F.col("query_id") % 8 == 2, F.create_map(F.lit("source"), F.lit("src1"))).alias("filters"), F.when(F.col("query_id") % 8 == 3, F.substring("text", 1, 3)).alias("rare_token"))


def golden_integrity(spark, sf):
    d = docs(spark, sf)
    return checks.integrity_findings(_golden(spark, sf), d, d.where("length(text) >= 120"))


def difficulty_rank1(spark, sf):
    g = _golden(spark, sf)
    ranks = g.where("id not like '%7'").select("id", F.when(F.col("id").like("%5"), None).otherwise((F.length("question") % 3).cast("int")).alias("target_rank")).groupBy("id").agg(F.max("target_rank").alias("target_rank"))
    return checks.rank_findings(g, ranks)


def difficulty_structure(spark, sf):
    return checks.structure_findings(_golden(spark, sf))


def question_target_overlap(spark, sf):
    """Terms that a question shares with each document it expects."""
    c = _cases(spark, sf).select("id", tx.search_terms(F.col("text")).alias("asked"), F.explode("expected").alias("doc_id"))
    d = docs(spark, sf).select("doc_id", tx.search_terms(F.col("text")).alias("have"))
    return c.join(d, "doc_id").select("id", "doc_id", F.size(F.array_intersect("asked", "have")).alias("shared"))


def usage_ledger(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("event_id") % 100).alias("p"), F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 50).otherwise(0).alias("c"))
    s = e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"))
    return s.withColumn("cost_usd", checks.cost_usd(F.lit(0), F.col("prompt_tokens"), F.col("completion_tokens")))


def cost_preflight(spark, sf):
    calls = checks.derive_calls(60, evaluate.CONFIGURATIONS, 8243, True, "openai", "none")
    t = docs(spark, sf).groupBy("lang").agg(F.sum(tx.chunk_token_estimate(F.col("text"))).alias("embedding_tokens"))
    t = t.withColumns({"generations": F.lit(calls.generations), "query_tokens": F.lit(calls.query_embeddings * 12), "max_context_tokens": F.lit(6000), "max_output_tokens": F.lit(701), "billed": F.col("lang") != "es"})
    return checks.estimate_cost(t).select("lang", "embedding_tokens", "query_tokens", "generations", "expected_usd", "upper_bound_usd")


def load_percentiles(spark, sf):
    """Nearest-rank percentiles by event type: the value at round(p (n - 1)), halves to the even; and an interpolated one."""
    e = table(spark, sf, "events").where("value is not null")
    nearest = lambda p: lambda n: F.bround((n - 1) * p, 0)
    place = lambda n: (n - 1) * 0.975
    found = ranks.values_at(e, ["event_type"], "value", {"p50": nearest(0.5), "p95": nearest(0.95), "below": lambda n: F.floor(place(n)), "above": lambda n: F.ceil(place(n))})
    mean = e.groupBy(F.col("event_type").alias("kind")).agg(F.round(F.avg("value"), 6).alias("mean"))
    between = F.col("below") + (F.col("above") - F.col("below")) * (place(F.col("n")) - F.floor(place(F.col("n"))))
    return found.join(mean, F.col("event_type").eqNullSafe(F.col("kind"))).select(
        "event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "least", "most")], "mean", F.round(between, 6).alias("type7_975"))


def payload_projection(spark, sf):
    h, _ = _prompt_hits(spark, sf)
    return h.select("query_id", "rank", F.to_json(F.struct(F.col("doc_id"), "source_path", F.round("score", 6).cast("decimal(20,6)").cast("string").alias("score"), "rank")).alias("payload"))


def chunk_documents(spark, sf):
    c = chunking.chunk_documents(docs(spark, sf))
    return c.where("kept").select("source_path", "chunk_index", "chunk_id", "point_id", "token_count_est", F.length("text").alias("n_chars"))


def chunk_stats(spark, sf):
    c = chunking.chunk_documents(docs(spark, sf))
    return c.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.max(F.length("text")).alias("longest"))


def sections_ancestry(spark, sf):
    """Headings of page texts made Markdown, with their ancestry."""
    md = F.coalesce("html", F.lit(""))
    for i in (1, 2, 3):
        md = F.regexp_replace(md, f"<h{i}[^>]*>([^<]*)</h{i}>", "\n" + "#" * i + " $1\n\n")
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_path"), md.alias("text"), F.lit("t").alias("title"), F.lit("pages").alias("source"), F.array().cast("array<string>").alias("tags"))
    c = chunking.chunk_documents(p, chunking.ChunkRules(least=1))
    return c.select("source_path", "chunk_index", "heading", "heading_path", F.length("text").alias("n_chars"))


def ingest_points(spark, sf):
    return ingest.points_of(chunking.chunk_documents(docs(spark, sf)), "run-1").select("point_id", "doc_id", "embedded_model", F.size("vector").alias("dim"))


QUERIES = {f.__name__: f for f in (
    sparse_search_topk, posting_search_topk, posting_statistics, tokenize_terms, term_hash, bm25_corpus_stats, bm25_document_weights, sparse_vectors, fake_embedding_vectors, dense_knn_cosine,
    dense_knn_label_recall, hybrid_rrf_fusion, hybrid_filtered, hybrid_zero_weight_branch, score_threshold_dropped, branch_contribution, rerank_term_coverage,
    context_budget_blocks, prompt_render, extractive_answer, cached_answers, refusal_reasons, citation_markers, uncited_sentences, judge_overlap, judge_reply_scores,
    golden_labels, case_predicates, tier1_per_case, tier1_by_category, hit_at_several_k, tier2_per_case, tier2_aggregates, ablation_modes,
    paired_delta_mcnemar, reportability, bootstrap_ci, scorecard_comparisons, mde, doc_chunk_point_ids, embed_text, token_estimates, path_functions,
    headings_and_tags, comments_stripped, stream_pieces, first_cited_sentences, filter_predicates, incremental_anti_join, upsert_merge, existing_point_ids,
    point_count, embedder_models, corpus_identity_hash, identities_compatible, cache_key_digest, golden_integrity, difficulty_rank1, difficulty_structure,
    question_target_overlap, usage_ledger, cost_preflight, load_percentiles, payload_projection, chunk_documents, chunk_stats, sections_ancestry, ingest_points,
)}
