"""Cluster my texts (C3, C4, C5, C9): text -> vectors -> reduced vectors ->
clusters + scores, and the same chain applied to new texts.

The chain is lazy DataFrames except for the fitted pieces (TF-IDF
vocabulary, SVD / PCA loadings, k-means centroids), each a documented
action.  Step-one output is checkpointed once and reused by the 2-D layout,
the clustering and the scores (the reference fits step one twice).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import agglomerative as AG
from tessera.operators import cluster as C
from tessera.operators import embed as E
from tessera.operators import layout as LY
from tessera.operators import reduce as R
from tessera.operators import scale as S
from tessera.operators import sparse_cluster as SP
from tessera.operators import tfidf as T
from tessera.operators.similarity import topk_between
from tessera.operators.umap import umap_layout
from tessera.session import reliable_checkpoint
from tessera.sources.keys import add_row_number

EMBEDDINGS = ("tfidf", "mean_word_vector", "idf_word_vector", "vectors")
STEPS = ("linear", "svd", "pca")
LAYOUTS = ("tsne", "umap")
REDUCTIONS = (*STEPS, *LAYOUTS, *(f"{s}__{x}" for s in STEPS for x in LAYOUTS))
SPACES = ("auto", "before", "after_step1", "after_full")


@dataclass(frozen=True)
class TextClusterConfig:
    embedding: str = "tfidf"
    tfidf: T.TfidfParams = field(default_factory=T.TfidfParams)
    reduction: str = "linear"          # one of REDUCTIONS; linear is svd on sparse input, pca on dense
    scale_before_reduction: str | None = None
    tsne_perplexity: float = 30.0
    tsne_iterations: int = 500
    umap_neighbours: int = 15
    umap_metric: str = "euclidean"
    umap_epochs: int = 100
    step_one_dims: int = 50
    svd_iterations: int = 5
    cluster_space: str = "auto"        # auto, before, after_step1, after_full
    scale_before_cluster: str | None = None
    n_clusters: int = 4
    distance_threshold: float | None = None  # agglomerative: in place of n_clusters
    algorithm: str = "agglomerative"   # agglomerative (reference default) or kmeans
    linkage: str = "average"
    affinity: str = "cosine"
    n_init: int = 20
    seed: int = 7742


@dataclass
class TextClusterModel:
    config: TextClusterConfig
    tfidf_model: T.TfidfModel | None
    svd_model: R.SvdModel | None
    pca_model: R.PcaModel | None
    centroids: list[list[float]]
    space: str
    assign_metric: str = "euclidean"
    sparse_clusters: SP.SparseClusters | None = None  # clustered before reduction on TF-IDF
    width: int = 0                                    # of dense vectors
    scale_in: S.ScaleModel = field(default_factory=S.ScaleModel)       # before reduction
    scale_clusters: S.ScaleModel = field(default_factory=S.ScaleModel)  # before clustering
    zero_cluster: int | None = None                   # of fitted rows whose clustered vector is all zeros
    layout: DataFrame | None = None                   # t-SNE and UMAP only: (vec, x_embed, y_embed) of the fitted rows
    members: DataFrame | None = None                  # single linkage only: (vec, cluster) of the fitted rows


def _first_step(config: TextClusterConfig, sparse: bool) -> str:
    """svd or pca, as the reduction setting says."""
    if config.reduction not in REDUCTIONS:
        raise ValueError(f"reduction must be one of {REDUCTIONS}, not {config.reduction!r}")
    step = config.reduction.split("__")[0]
    if step in ("linear", *LAYOUTS):
        step = "svd" if sparse else "pca"
    if step == "pca" and sparse:
        raise ValueError("pca centres its input, which a sparse TF-IDF matrix can't hold: use svd or linear")
    return step


def _long(raw: DataFrame) -> DataFrame:
    """Dense vectors in long form, a term for each dimension."""
    long = raw.select("doc_id", F.posexplode("vec").alias("_d", "weight")).where(F.col("weight") != 0)
    return long.select("doc_id", F.lpad(F.col("_d").cast("string"), 7, "0").alias("term"), "weight")


def _dense_vectors(docs: DataFrame, config: TextClusterConfig, word_vectors: DataFrame | None, idf: T.TfidfModel | None) -> DataFrame:
    if config.embedding == "mean_word_vector":
        raw = E.mean_word_vector_embed(docs, word_vectors, out="vec")
    elif config.embedding == "idf_word_vector":
        raw = E.idf_weighted_word_vector_embed(docs, word_vectors, model=idf, out="vec")
    elif config.embedding == "vectors":
        raw = docs.select("doc_id", V.clean("vec").alias("vec"))
    else:
        raise ValueError(f"embedding must be one of {EMBEDDINGS}")
    return raw.select("doc_id", "vec")


def _named(docs: DataFrame, id_col: str, text_col: str | None, vec_col: str | None) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *([F.col(text_col).alias("text")] if text_col else []),
                       *([F.col(vec_col).alias("vec")] if vec_col else []))


def _laid_out(config: TextClusterConfig) -> str:
    return "vec" if config.reduction in LAYOUTS and config.embedding != "tfidf" else "step1"


def _every_row(ids: DataFrame, rows: DataFrame, col: str, size: int) -> DataFrame:
    """``rows`` for all ``ids``; what has no vector (no known term) gets the zero vector."""
    zero = F.array_repeat(F.lit(0.0), size)
    return ids.select("doc_id").join(rows, "doc_id", "left").withColumn(col, F.coalesce(F.col(col), zero))


def _space(config: TextClusterConfig, sparse: bool) -> str:
    if config.cluster_space not in SPACES:
        raise ValueError(f"cluster_space must be one of {SPACES}")
    if config.cluster_space != "auto":
        return config.cluster_space
    # One-step types cluster before any reduction; on sparse TF-IDF only k-means
    # does so, when asked for ("before"): the step-one space serves both algorithms.
    return "after_step1" if sparse else "before"


def cluster_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  config: TextClusterConfig = TextClusterConfig(), word_vectors: DataFrame | None = None,
                  vec_col: str | None = None):
    """Returns (frame ``doc_id, x_embed, y_embed, cluster``, one-row
    scores frame, fitted model)."""
    docs = _named(docs, id_col, text_col, vec_col)
    if docs.isEmpty():
        raise ValueError("no texts to cluster")
    sparse = config.embedding == "tfidf"
    tf_model = svd_model = pca_model = fitted_layout = members = None
    scale_in, width = S.ScaleModel(), (0,)
    first = _first_step(config, sparse)
    if sparse and config.scale_before_reduction:
        raise ValueError("scaling before reduction needs dense vectors")
    long_form = sparse and config.cluster_space == "before"
    if long_form and (config.algorithm != "kmeans" or config.scale_before_cluster):
        raise ValueError("clustering before reduction on TF-IDF is k-means without scaling")
    if sparse:
        tf_model, weights = T.tfidf_fit_transform(docs, "doc_id", "text", config.tfidf)
        if long_form:
            weights = reliable_checkpoint(weights)
        svd_model, step1 = R.truncated_svd(weights, k=config.step_one_dims, n_iter=config.svd_iterations,
                                           seed=config.seed)
        step1 = _every_row(docs, step1.withColumnRenamed("reduced", "step1"), "step1", len(svd_model.singular_values))
    else:
        if config.embedding == "idf_word_vector":
            tf_model = T.tfidf_fit(docs, "doc_id", "text")
        raw = reliable_checkpoint(_dense_vectors(docs, config, word_vectors, tf_model))
        width = raw.where("vec is not null").select(F.size("vec")).first()
        if width is None:
            raise ValueError("no text has a vector")
        raw = raw.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), width[0])))
        if config.scale_before_reduction:
            scale_in = S.fit_scale(raw, "vec", config.scale_before_reduction)
            raw = reliable_checkpoint(scale_in.transform(raw, "vec", "vec"))
        if first == "svd":
            svd_model, step1 = R.truncated_svd(_long(raw), k=min(config.step_one_dims, width[0]), n_iter=config.svd_iterations, seed=config.seed)
            step1 = _every_row(raw, step1.withColumnRenamed("reduced", "step1"), "step1", len(svd_model.singular_values))
            step1 = step1.join(raw, "doc_id")
        else:
            pca_model = R.pca(raw, "vec", min(config.step_one_dims, width[0]))
            step1 = pca_model.transform(raw, "vec", "step1").select("doc_id", "step1", "vec")
    step1 = reliable_checkpoint(step1)
    space = _space(config, sparse) if not ("__" in config.reduction and config.cluster_space == "auto") else "after_step1"
    if config.reduction.endswith(LAYOUTS):
        # Step one (SVD / PCA) feeds the layout; the step-one frame is
        # materialised once and reused by layout, clustering and scores.
        # A layout alone takes the dense vectors themselves (sparse: the step-one space).
        col = _laid_out(config)
        rows = step1.select("doc_id", col)
        if config.reduction.endswith("umap"):
            layout = umap_layout(rows, "doc_id", col, config.umap_neighbours, config.umap_metric, epochs=config.umap_epochs, seed=config.seed)
        else:
            layout = LY.tsne_layout(rows, "doc_id", col, config.tsne_perplexity, config.tsne_iterations)
        layout = reliable_checkpoint(layout)
        fitted_layout = step1.select("doc_id", F.col(col).alias("vec")).join(layout, "doc_id").select("vec", "x_embed", "y_embed")
    else:
        layout = step1.select("doc_id", F.element_at("step1", 1).alias("x_embed"),
                              F.element_at("step1", 2).alias("y_embed"))
    if long_form:
        labelled, fitted = SP.sparse_kmeans(weights, config.n_clusters, "euclidean", config.n_init, config.seed, ids=docs)
        labelled = reliable_checkpoint(labelled)
        model = TextClusterModel(config, tf_model, svd_model, None, [], space, sparse_clusters=fitted)
        return layout.join(labelled, "doc_id"), SP.sparse_scores(weights, labelled), model
    if space == "after_step1":
        cvec = step1.select("doc_id", F.col("step1").alias("cv"))
    elif space == "after_full":
        cvec = layout.select("doc_id", F.array("x_embed", "y_embed").alias("cv"))
    else:
        cvec = step1.select("doc_id", F.col("vec").alias("cv"))
    scale_clusters = S.fit_scale(cvec, "cv", config.scale_before_cluster)
    scaled = scale_clusters.transform(cvec, "cv", "sv")
    if config.algorithm == "kmeans":
        labelled, centroids = C.kmeans(scaled, "sv", config.n_clusters, config.n_init, config.seed, id_col="doc_id")
        assign_metric = "euclidean"
    elif config.algorithm == "agglomerative":
        labelled = AG.agglomerative(scaled, "sv", config.n_clusters, config.linkage, config.affinity,
                                    id_col="doc_id", seed=config.seed,
                                    distance_threshold=config.distance_threshold)
        labelled = reliable_checkpoint(labelled)  # read by the centroids and the scores
        mean_cos = config.linkage == "average" and config.affinity == "cosine"
        centroids = _centroids(labelled, "sv", unit=mean_cos)
        assign_metric = "mean_cosine" if mean_cos else ("euclidean" if config.affinity in ("euclidean", "l2")
                                                         else config.affinity)
    else:
        raise ValueError("algorithm must be 'agglomerative' or 'kmeans'")
    labelled = reliable_checkpoint(labelled.select("doc_id", "cv", "sv", "cluster"))
    if config.algorithm == "agglomerative" and config.linkage == "single":
        members = labelled.select(F.col("sv").alias("vec"), "cluster")
    zero = labelled.where(_is_zero("cv")).agg(F.min("cluster")).first()[0]
    frame = layout.join(labelled.select("doc_id", "cluster"), "doc_id")
    scores = (C.silhouette(labelled, "cv", "cluster")
              .join(C.calinski_harabasz(labelled, "cv", "cluster"), how="inner")
              .join(C.davies_bouldin(labelled, "cv", "cluster"), how="inner"))
    model = TextClusterModel(config, tf_model, svd_model, pca_model, centroids, space, assign_metric, width=width[0], scale_in=scale_in,
                             scale_clusters=scale_clusters, zero_cluster=zero, layout=fitted_layout, members=members)
    return frame, scores, model


def _centroids(labelled: DataFrame, vec_col: str, unit: bool) -> list[list[float]]:
    """Per-cluster mean vectors (of unit vectors when ``unit``), k x d, checked."""
    vec = F.col(vec_col).cast("array<double>")
    summ = C.cluster_summaries(labelled, "cluster", V.normalize(vec) if unit else vec)
    return [[x / s["n"] for x in s["s"]] for s in summ]


def _is_zero(col: str):
    return F.forall(col, lambda x: x == 0)


def assign_texts(new_docs: DataFrame, model: TextClusterModel, id_col: str = "doc_id", text_col: str | None = "text",
                 vec_col: str | None = None, word_vectors: DataFrame | None = None) -> DataFrame:
    """The fitted stages (vectors, scaling, reduction or layout, scaling) applied to new rows, then the nearest fitted cluster:
    ``doc_id, cluster``, labels unchanged, any number of rows, nothing fitted again.

    Nearest by centroid; by mean cosine distance to the members (average linkage with cosine); by the nearest member (single
    linkage).  Rows without a vector (null or empty texts, no known word, null vectors) count as zero vectors, as in the fit,
    and vectors of zeros get the cluster of the fitted ones, if there were any.  A layout (t-SNE, UMAP) places new rows by
    ``layout_transform``.  ``word_vectors`` is the table of the fit, for embeddings by words; ids are taken as unique, and
    an empty table stays empty."""
    config = model.config
    docs = _named(new_docs, id_col, text_col if config.embedding != "vectors" else None, vec_col)
    if model.sparse_clusters is not None:
        found = SP.assign_sparse(T.tfidf_transform(docs, model.tfidf_model), model.sparse_clusters, docs)
        return docs.select("doc_id").join(found, "doc_id", "left")
    if config.embedding == "tfidf":
        weights = T.tfidf_transform(docs, model.tfidf_model)
        rows = docs.select("doc_id")
    else:
        if config.embedding != "vectors" and word_vectors is None:
            raise ValueError("embeddings by words need the word vectors of the fit")
        raw = _every_row(docs, _dense_vectors(docs, config, word_vectors, model.tfidf_model), "vec", model.width)
        raw = model.scale_in.transform(raw, "vec", "vec")
        rows = raw = reliable_checkpoint(raw.select("doc_id", "vec"))
        weights = _long(raw)
    if model.svd_model is not None:
        step1 = model.svd_model.transform(weights, out="step1")
        rows = rows.join(_every_row(docs, step1, "step1", len(model.svd_model.singular_values)), "doc_id")
    else:
        rows = model.pca_model.transform(rows, "vec", "step1")
    if model.space == "after_full" and model.layout is not None:
        col = _laid_out(config)
        new = reliable_checkpoint(rows.select("doc_id", F.col(col).alias("vec")))
        metric = config.umap_metric if config.reduction.endswith("umap") else "euclidean"
        rows = LY.layout_transform(new, "doc_id", "vec", model.layout, metric=metric).select("doc_id", F.array("x_embed", "y_embed").alias("cv"))
    elif model.space == "after_full":
        rows = rows.select("doc_id", F.slice("step1", 1, 2).alias("cv"))
    else:
        rows = rows.select("doc_id", F.col("step1" if model.space == "after_step1" else "vec").alias("cv"))
    rows = model.scale_clusters.transform(rows, "cv", "sv")
    if model.members is not None:
        rows = reliable_checkpoint(rows)
        numbered = add_row_number(model.members, ["cluster", "vec"], "n")
        near = topk_between(rows, "doc_id", "sv", numbered, "n", "vec", 1, {"l2": "euclidean", "l1": "manhattan"}.get(config.affinity, config.affinity))
        found = near.join(numbered.select(F.col("n").alias("id2"), "cluster"), "id2").select(F.col("id1").alias("doc_id"), "cluster")
        rows = rows.join(found, "doc_id", "left")
    else:
        rows = C.assign_nearest(rows, "sv", model.centroids, "cluster", metric=model.assign_metric)
    if model.zero_cluster is not None:
        rows = rows.withColumn("cluster", F.when(_is_zero("cv"), model.zero_cluster).otherwise(F.col("cluster")))
    return docs.select("doc_id").join(rows.select("doc_id", "cluster"), "doc_id", "left")


def _tables(model: TextClusterModel) -> dict[str, DataFrame]:
    found = {"layout": model.layout, "members": model.members}
    if model.tfidf_model is not None:
        found["vocabulary"] = model.tfidf_model.vocabulary
    if model.svd_model is not None:
        found["loadings"] = model.svd_model.loadings
    if model.sparse_clusters is not None:
        found["sparse_centroids"], found["sparse_norms"] = model.sparse_clusters.centroids, model.sparse_clusters.norms
    return {name: df for name, df in found.items() if df is not None}


def save_model(model: TextClusterModel, path: str) -> None:
    """Writes the fitted stages under ``path`` (a new folder that the whole cluster sees): tables as parquet, numbers as one row of
    JSON, written last.  The word vectors of embeddings by words aren't copied."""
    tables = _tables(model)
    facts = {"config": asdict(model.config), "tables": sorted(tables), "centroids": model.centroids, "space": model.space,
             "assign_metric": model.assign_metric, "width": model.width, "scale_in": asdict(model.scale_in),
             "scale_clusters": asdict(model.scale_clusters), "zero_cluster": model.zero_cluster,
             "sparse_metric": model.sparse_clusters.metric if model.sparse_clusters else None,
             "pca": asdict(model.pca_model) if model.pca_model else None,
             "singular_values": model.svd_model.singular_values if model.svd_model else None}
    if model.tfidf_model is not None:
        t = model.tfidf_model
        facts["tfidf"] = {"n_docs": t.n_docs, "n_terms": t.n_terms, "max_idf": t.max_idf, "params": asdict(t.params)}
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")
    SparkSession.active().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("error").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> TextClusterModel:
    """The model that ``save_model`` wrote under ``path``."""
    facts = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in facts["tables"]}

    def params(found: dict) -> T.TfidfParams:
        stop = found["stop_words"]
        return T.TfidfParams(**{**found, "stop_words": tuple(stop) if isinstance(stop, list) else stop})

    config = TextClusterConfig(**{**facts["config"], "tfidf": params(facts["config"]["tfidf"])})
    model = TextClusterModel(config, None, None, R.PcaModel(**facts["pca"]) if facts["pca"] else None, facts["centroids"], facts["space"],
                             facts["assign_metric"], width=facts["width"], scale_in=S.ScaleModel(**facts["scale_in"]),
                             scale_clusters=S.ScaleModel(**facts["scale_clusters"]), zero_cluster=facts["zero_cluster"],
                             layout=tables.get("layout"), members=tables.get("members"))
    if "tfidf" in facts:
        t = facts["tfidf"]
        model.tfidf_model = T.TfidfModel(tables["vocabulary"], t["n_docs"], t["n_terms"], t["max_idf"], params(t["params"]))
    if "loadings" in tables:
        model.svd_model = R.SvdModel(len(facts["singular_values"]), facts["singular_values"], tables["loadings"])
    if "sparse_norms" in tables:
        model.sparse_clusters = SP.SparseClusters(tables["sparse_centroids"], tables["sparse_norms"], facts["sparse_metric"])
    return model
