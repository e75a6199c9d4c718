"""What experiments are made of: detector wrappers, timing, grids, questions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import numbered_lines
from graphloom.operators import quality
from graphloom.operators.evaluate import size_ladder
from graphloom.operators.graph import components, induced, sample_nodes
from graphloom.operators.reports import map_model
from graphloom.session import materialize

Detect = Callable[[DataFrame, DataFrame, int], DataFrame]


def by_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each component a community, numbered by descending size."""
    from graphloom.operators.detectors import numbered

    return numbered(components(edges, vertices).select("node", F.col("component").alias("name")))


def adapt(detect: Detect) -> Detect:
    """``detect`` with a result for every node: components where it fails or finds nothing, else nodes it left out join the largest community."""

    def run(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
        try:
            found = materialize(detect(edges, vertices, k).select("node", "community"), "adapted")
            empty = found.isEmpty()
        except Exception:  # whatever a detector raises, the experiment goes on
            empty = True
        return by_components(edges, vertices) if empty else quality.complete_largest(found, vertices)

    return run


def size_targeted(detect: Detect, edges: DataFrame, vertices: DataFrame, target_size: int) -> DataFrame:
    """A detector asked for as many communities as give ``target_size`` nodes each, one at least."""
    return detect(edges, vertices, max(1, vertices.count() // target_size))


def within(spark: SparkSession, seconds: float, work: Callable[[], DataFrame], otherwise: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``work``, or of ``otherwise`` where it takes longer: its Spark jobs are then cancelled."""
    tag, result, failure = f"within-{time.monotonic_ns()}", [], []

    def run() -> None:
        spark.addTag(tag)
        try:
            result.append(materialize(work(), "within"))
        except Exception as e:  # handed to the caller below
            failure.append(e)

    from pyspark import InheritableThread

    thread: threading.Thread = InheritableThread(target=run, daemon=True, session=spark)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        return otherwise()
    if failure:
        raise failure[0]
    return result[0]


def detect_within(spark: SparkSession, seconds: float, detect: Detect, edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """A detector with a time limit; past it the nodes in order are cut into floor(sqrt n) slices."""

    def slices() -> DataFrame:
        n = vertices.count()
        return quality.slice_partition(vertices, max(1, int(n**0.5)), n)

    return within(spark, seconds, lambda: detect(edges, vertices, k), slices)


def scalability(spark: SparkSession, edges: DataFrame, vertices: DataFrame, detectors: dict[str, Detect], seconds: float = 120, ladder: list[int] | None = None) -> DataFrame:
    """``(algorithm, N, k, seconds, communities)``: every detector on nested samples of growing size, after a warm-up on the smallest."""
    out = []
    sizes = ladder or size_ladder(vertices.count())
    for i, n in enumerate([sizes[0], *sizes]):
        nodes = materialize(sample_nodes(vertices, n), "sample")
        links = materialize(induced(edges, nodes), "sample-edges")
        k = max(2, min(50, max(2, n // 4)))
        for name, detect in detectors.items():
            start = time.perf_counter()
            found = detect_within(spark, seconds, detect, links, nodes, k).select("community").distinct().count()
            if i:
                out.append((name, n, k, time.perf_counter() - start, found))
    return spark.createDataFrame(out, "algorithm string, N long, k int, seconds double, communities long")


def throughput(done: int, seconds: float) -> float:
    """Items a second."""
    return done / seconds if seconds > 0 else 0.0


def ill_conditioned(matrix: np.ndarray, limit: float = 1e12) -> bool:
    """Whether the ratio of a symmetric matrix's extreme eigenvalues passes ``limit``: k-means then takes more starts."""
    values = np.linalg.eigvalsh(matrix)
    return bool(values[-1] / (values[0] + 1e-10) > limit)


#: Settings tried for each algorithm.
GRIDS = {
    "leiden": [{}, {"resolution": 2.0}, {"resolution": 0.5}],
    "spectral_clustering": [{"k": k} for k in (5, 10, 15, 20)],
    "tight_community": [{"k": k, "tight_threshold": t} for k, t in ((6, 0.1), (8, 0.3), (10, 0.5), (12, 0.7), (15, 0.9))],
    "nac_algorithm1": [{"k": k} for k in (6, 8, 12, 16, 20)],
    "nac_algorithm2": [{"k": k, "alpha": a} for k, a in ((6, 0.3), (8, 0.5), (10, 0.7), (12, 0.5), (15, 0.9))],
}


def parameter_grid(spark: SparkSession, algorithms: list[str] | None = None) -> DataFrame:
    """``(algorithm, setting, k, alpha, resolution, tight_threshold)``; an algorithm without a grid has one setting of its defaults."""
    rows = []
    for name in algorithms or list(GRIDS):
        for i, p in enumerate(GRIDS.get(name, [{}])):
            rows.append((name, i, p.get("k"), p.get("alpha"), p.get("resolution"), p.get("tight_threshold")))
    return spark.createDataFrame(rows, "algorithm string, setting int, k int, alpha double, resolution double, tight_threshold double")


#: How a column header names a metric.
METRIC_PREFIXES = (("comprehensiv", "Comprehensiveness"), ("divers", "Diversity"), ("empower", "Empowerment"), ("direct", "Directness"))


def metric_of(header: Column) -> Column:
    """The metric that a column header names by its beginning; '' for none."""
    h = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    out = F.lit("")
    for prefix, metric in reversed(METRIC_PREFIXES):
        out = F.when(h.startswith(prefix), metric).otherwise(out)
    return out


def best_split(candidates: DataFrame, at_least: float) -> DataFrame:
    """The community to split next from ``(community, size, density, internal, external)``: n (1 - density) (1 + conductance), ties to the larger, then the smaller id."""
    edges = F.col("internal") + F.col("external")
    conductance = F.when(edges > 0, F.col("external") / (2 * F.col("internal") + F.col("external"))).otherwise(0.0)
    scored = candidates.withColumn("score", F.col("size") * (1 - F.col("density")) * (1 + conductance))
    return scored.where(F.col("score") >= at_least).orderBy(F.desc("score"), F.desc("size"), "community").limit(1)


def zip_by_index(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Items and responses with one index, side by side; an item without a response keeps a null."""
    return items.join(responses, "index", "left")


def with_title_ids(entities: DataFrame) -> DataFrame:
    """``entities`` and, for each title that is no id yet, its rows again under the title as id."""
    titled = entities.where((F.col("title").isNotNull()) & (F.col("title") != ""))
    known = entities.select(F.col("id").alias("title")).distinct()
    return entities.unionByName(titled.join(known, "title", "left_anti").withColumn("id", F.col("title")).select(*entities.columns))


def unit_previews(communities: DataFrame, units: DataFrame, look: int = 5, show: int = 3, chars: int = 200) -> DataFrame:
    """``(community, previews)``: of each community's first ``look`` text units the first ``show`` that have text, cut to ``chars``."""
    first = communities.select("community", F.posexplode(F.slice("text_unit_ids", 1, look)).alias("pos", "unit"))
    text = units.where(F.coalesce("text", F.lit("")) != "").select(F.col("id").alias("unit"), F.substring("text", 1, chars).alias("text"))
    line = F.concat(F.lit("- Text unit "), F.col("unit").cast("string"), F.lit(": "), F.col("text"), F.lit("..."))
    found = first.join(text, "unit").groupBy("community").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), 1, show).alias("l"))
    return found.select("community", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("previews"))


def _persona_prompt(k: Column | int) -> Column:
    return F.concat(F.lit("Name "), F.lit(k).cast("string"), F.lit(" kinds of people who would use this corpus, one a line, as\nUser 1: [role] - [description]\n\nCorpus:\n"), F.col("description"))


def questions(corpus: DataFrame, ask: Callable[[list[str]], list[str]], users: int = 3, tasks: int = 3, each: int = 3) -> DataFrame:
    """``(user, task, question, persona, task_text, question_text)`` about a one-row ``corpus(description)``.

    Up to ``users`` personas, each with up to ``tasks`` tasks, each of those with
    up to ``each`` questions; every step asks the model for all rows at once.
    """

    def step(rows: DataFrame, prompt: Column, limit: int, number: str, text: str, word: str) -> DataFrame:
        answered = map_model(rows.withColumn("prompt", prompt), ask, "prompt", "response")
        kept = [c for c in rows.columns if c not in ("prompt", "response")]
        return answered.select(*kept, F.posexplode(numbered_lines(F.col("response"), limit, (word,))).alias(number, text))

    people = step(corpus.select("description"), _persona_prompt(users), users, "user", "persona", "User")
    task = F.concat(F.lit(f"Give {tasks} tasks this person has for the corpus, one a line, as\nTask 1: [task]\n\nPerson: "), F.col("persona"), F.lit("\n\nCorpus:\n"), F.col("description"))
    jobs = step(people, task, tasks, "task", "task_text", "Task")
    ask_for = F.concat(F.lit(f"Ask {each} questions that need the whole corpus, one a line, as\nQuestion 1: [question]\n\nPerson: "), F.col("persona"), F.lit("\nTask: "), F.col("task_text"), F.lit("\n\nCorpus:\n"), F.col("description"))
    return step(jobs, ask_for, each, "question", "question_text", "Question").select("user", "task", "question", "persona", "task_text", "question_text")
