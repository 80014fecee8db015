"""Every query of the engine over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.grades import BIN_LABELS, scale_a, scale_b, scale_c, score_bin, stretch_above
from ..functions.text import short_node
from ..ml import models, store, training
from ..operators import audit, benchmarks, cohort, distribution, graph, knowledge, quarantine, reshape, value_added
from ..session import materialise, new_folder, steps
from ..sources import adapters as src, committed, sinks
from ..sources.tables import query
from . import ingest

Query = Callable[[SparkSession, str], DataFrame]

COURSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]
CORE_ROLES = {"base": ("ECONOMY", "1998"), "advanced": ("LARGE", "1998"), "structures": ("MEDIUM", "1999")}
ROLES = {**CORE_ROLES, "target": ("PROMO", "2000")}
REPORT_KEYS = ["class_id", "course", "chapter"]

_QUERIES: dict[str, Query] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for output, so that the last bits of a sum do not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- listings and ranking -------------------------------------------------


@_query
def cohort_gpa_rank(spark, sf):
    return cohort.cohort_gpa_rank(src.enrollment(spark, sf))


@_query
def gender_distribution(spark, sf):
    return cohort.gender_distribution(src.student(spark, sf))


@_query
def students_by_major(spark, sf):
    return cohort.students_by_major(src.enrollment(spark, sf), src.ROW_ORDER)


def _courses(spark, sf):
    rows = src.enrollment(spark, sf)
    return cohort.first_row(rows, ["course_code"], ["class_id", *src.ROW_ORDER], ["course_name"])


@_query
def course_listing(spark, sf):
    return cohort.listing(_courses(spark, sf))


@_query
def course_lookup(spark, sf):
    sql = "SELECT course_code, course_name FROM {course} WHERE course_code = :code"
    return query(spark, sql, {"course": _courses(spark, sf)}, code="Brand#3")


# --- grade scales and distributions ---------------------------------------


def _scale(scale) -> Query:
    def run(spark, sf):
        rows = src.enrollment(spark, sf).select("grade_text", scale(F.col("grade_text")).alias("score"))
        return rows.groupBy("grade_text", "score").agg(F.count(F.lit(1)).alias("n"))

    return run


_QUERIES["grade_scale_a"] = _scale(scale_a)
_QUERIES["grade_scale_b"] = _scale(scale_b)
_QUERIES["grade_scale_c"] = _scale(scale_c)


@_query
def violin_rough(spark, sf):
    return distribution.violin_rows(src.enrollment(spark, sf))


@_query
def violin_exam_only(spark, sf):
    return distribution.violin_rows(src.enrollment(spark, sf), exam_course="1", nature="1")


@_query
def violin_filtered(spark, sf):
    """Every filter has a text; students without a major do not match any."""
    filters = {"cohort": "A", "course": "M", "major": "I", "semester": "1", "academic_year": "199"}
    return distribution.violin_rows(src.irregular_enrollment(spark, sf), **filters)


@_query
def grade_distribution(spark, sf):
    rows = distribution.violin_rows(src.enrollment(spark, sf))
    return _rounded(distribution.five_numbers(rows, ["x", "courseName"], "y"), 6, "mean")


# --- student home ---------------------------------------------------------

_MEANS = ("class_mean", "major_mean")


@_query
def student_home_line(spark, sf):
    home = benchmarks.home_scores(src.enrollment(spark, sf))
    return _rounded(benchmarks.home_line(home), 6, *_MEANS)


@_query
def student_home_radar(spark, sf):
    home = benchmarks.home_scores(src.enrollment(spark, sf))
    return _rounded(benchmarks.home_radar(home), 6, "score")


@_query
def home_pooled(spark, sf):
    """All students as one: the request without a student."""
    home = benchmarks.home_scores(src.enrollment(spark, sf), semester="1", by=())
    return _rounded(benchmarks.home_line(home), 6, *_MEANS)


@_query
def irregular_home_line(spark, sf):
    """Long course names, students without class or major, and means of zero, which read as missing."""
    home = benchmarks.home_scores(src.irregular_enrollment(spark, sf))
    return _rounded(benchmarks.home_line(home), 6, *_MEANS)


@_query
def irregular_home_radar(spark, sf):
    """As ``irregular_home_line``; means of zero stay."""
    home = benchmarks.home_scores(src.irregular_enrollment(spark, sf))
    return _rounded(benchmarks.home_radar(home), 6, "score")


@_query
def weak_subjects(spark, sf):
    home = benchmarks.home_scores(src.enrollment(spark, sf))
    return _rounded(benchmarks.weak_subjects(home), 6, "class_mean")


@_query
def student_report_text(spark, sf):
    return benchmarks.student_report(benchmarks.home_scores(src.enrollment(spark, sf)))


# --- value added ----------------------------------------------------------


@_query
def class_value_added(spark, sf):
    return _rounded(value_added.class_value_added(src.enrollment(spark, sf), src.ROW_ORDER), 9, "y")


@_query
def student_value_added_slope(spark, sf):
    return _rounded(value_added.student_value_added(src.enrollment(spark, sf), src.ROW_ORDER), 9, "value_added")


@_query
def semester_gpa_residuals(spark, sf):
    rows = value_added.semester_gpa_residuals(src.enrollment(spark, sf), src.student(spark, sf))
    return _rounded(rows, 7, "gpa", "gpa_residual", "class_gpa_residual", "major_gpa_residual")


@_query
def course_means(spark, sf):
    return _rounded(value_added.course_means(src.enrollment(spark, sf), COURSES), 6, "actual")


@_query
def course_expected_gain(spark, sf):
    gains = value_added.expected_gain(src.enrollment(spark, sf), COURSES)
    return _rounded(gains, 6, "actual", "expected", "gain")


@_query
def course_line_residuals(spark, sf):
    rows = value_added.line_residuals(src.enrollment(spark, sf), COURSES)
    return _rounded(rows, 6, "actual", "predicted", "residual")


@_query
def value_added_radar(spark, sf):
    gains = value_added.expected_gain(src.enrollment(spark, sf), COURSES)
    return _rounded(value_added.gain_radar(gains), 6, "score")


@_query
def gain_report_text(spark, sf):
    return value_added.gain_report(value_added.expected_gain(src.enrollment(spark, sf), COURSES))


# --- sheets and upserts ---------------------------------------------------


def _points_by_id(spark, sf):
    """Points named by their id, as the scoring sheet names them."""
    points = src.knowledge_point(spark, sf).select("kp_id")
    return points.withColumn("kp_name", F.col("kp_id").cast("string"))


def _scoring_cells(spark, sf):
    return reshape.scoring_cells(src.scoring_sheet(spark, sf), _points_by_id(spark, sf), header="kp_")


def _stages(spark, sf):
    return reshape.with_stage(src.scoring(spark, sf))


@_query
def unpivot_scores(spark, sf):
    return reshape.unpivot_scores(src.score_sheet(spark, sf), src.score_point(spark, sf), "1998")


@_query
def stage_pre_year(spark, sf):
    return _stages(spark, sf)


@_query
def stage_assignment(spark, sf):
    return reshape.stage_assignment(_scoring_cells(spark, sf), "1999")


@_query
def stage_upsert(spark, sf):
    new = reshape.stage_assignment(_scoring_cells(spark, sf), "1999")
    return reshape.upsert(_stages(spark, sf), new, ["kp_id", "year"])


@_query
def scoring_update(spark, sf):
    return reshape.update_scoring(src.scored_point(spark, sf), _scoring_cells(spark, sf))


@_query
def stage_table_upsert(spark, sf):
    """Two upserts into a table that does not exist at first; points change their stage, by which it is partitioned."""
    path, key = new_folder(spark), ["kp_id", "year"]
    committed.upsert(spark, path, "stages", _stages(spark, sf), key, "stage")
    new = reshape.stage_assignment(_scoring_cells(spark, sf), "1999")
    committed.upsert(spark, path, "stages", new, key, "stage")
    return committed.read_committed(spark, path, "stages")


@_query
def scoring_table_update(spark, sf):
    """The points that a sheet names get its scoring items in a stored table partitioned by them."""
    path, points, cells = new_folder(spark), src.scored_point(spark, sf), materialise(_scoring_cells(spark, sf))
    committed.upsert(spark, path, "points", points, ["kp_id"], "scoring")
    named = points.join(cells.select("kp_id").distinct(), "kp_id", "left_semi")
    committed.upsert(spark, path, "points", reshape.update_scoring(named, cells), ["kp_id"], "scoring")
    return committed.read_committed(spark, path, "points")


@_query
def prereq_edges(spark, sf):
    return graph.prereq_edges(src.prereq_sheet(spark, sf))


@_query
def prereq_nodes(spark, sf):
    return graph.prereq_nodes(src.prereq_sheet(spark, sf))


@_query
def prereq_node_keys(spark, sf):
    nodes = graph.prereq_nodes(src.prereq_sheet(spark, sf)).withColumn("course", F.lit("数据结构"))
    return graph.assign_keys(nodes)


@_query
def new_courses(spark, sf):
    return reshape.insert_missing(_courses(spark, sf), src.existing_courses(spark, sf), "course_code")


@_query
def new_students(spark, sf):
    rows = cohort.first_row(
        src.enrollment(spark, sf), ["student_id"], ["class_id", *src.ROW_ORDER],
        ["name", "major", "class_id", "gender"],
    )
    return reshape.insert_missing(rows, src.existing_students(spark, sf), "student_id")


# --- sheets as files ------------------------------------------------------


def _file(sheet):
    """The sheet written as a CSV file; its rows keep their order."""
    path = new_folder(sheet.sparkSession)
    sinks.write_sheet(sheet, path)
    return path


@_query
def ingest_scores(spark, sf):
    file = _file(src.score_sheet(spark, sf).withColumnRenamed("student_id", ingest.STUDENT_HEADER))
    store = new_folder(spark)
    ingest.scores(spark, file, src.score_point(spark, sf), store, "1998")
    return committed.read_committed(spark, store, "student_knowledge")


def _scoring_file(spark, sf):
    sheet = src.scoring_sheet(spark, sf).orderBy("row_no")
    return _file(sheet.select("scoring", *(F.col(f"kp_{i}").alias(f"{reshape.POINT_HEADER}{i}") for i in (1, 2, 3))))


@_query
def ingest_stages(spark, sf):
    store = new_folder(spark)
    ingest.stages(spark, _scoring_file(spark, sf), _points_by_id(spark, sf), store, "1999")
    return committed.read_committed(spark, store, "stage_pre_year")


@_query
def ingest_rejected(spark, sf):
    """What the scoring sheet names and no point is."""
    store = new_folder(spark)
    ingest.stages(spark, _scoring_file(spark, sf), _points_by_id(spark, sf), store, "1999")
    return committed.read_committed(spark, store, "rejected").select("item", "cell", "reason")


@_query
def ingest_graph(spark, sf):
    headers = {name: header for header, name in graph.SHEET_HEADERS.items()}
    file = _file(src.prereq_sheet(spark, sf).orderBy("row_no").drop("row_no").withColumnsRenamed(headers))
    store = new_folder(spark)
    ingest.prerequisites(spark, file, "数据结构", store)
    return graph.elements(*(committed.read_committed(spark, store, name) for name in ("points", "edges")))


@_query
def grade_quarantine(spark, sf):
    """Enrolments by scale and reason, read from where good and bad ones were written."""
    store, counts = new_folder(spark), []
    with steps(spark):  # the enrolments are joined once for all scales
        rows = materialise(src.enrollment(spark, sf).select("student_id", "course_name", "grade_text"))
        for scale in quarantine.SCALES:
            quarantine.set_apart(quarantine.judged(rows, scale), store, f"scale_{scale}")
    for scale in quarantine.SCALES:
        written = committed.read_committed(spark, store, f"scale_{scale}")
        counts.append(written.groupBy(F.lit(scale).alias("scale"), "status", "reason").agg(F.count(F.lit(1)).alias("n")))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- knowledge graph ------------------------------------------------------


def _nodes(spark, sf):
    return src.knowledge_point(spark, sf).select(F.col("kp_id").alias("id"), F.col("kp_name").alias("name"))


@_query
def graph_degrees(spark, sf):
    return graph.degrees(_nodes(spark, sf), src.knowledge_edge(spark, sf))


@_query
def graph_adjacency(spark, sf):
    return graph.adjacency(src.knowledge_edge(spark, sf))


@_query
def graph_neighbourhood(spark, sf):
    return graph.neighbourhood(src.knowledge_edge(spark, sf))


@_query
def graph_leaf_points(spark, sf):
    nodes = graph.prereq_nodes(src.prereq_sheet(spark, sf)).select(F.col("name").alias("id"))
    return graph.leaf_points(nodes, graph.prereq_edges(src.prereq_sheet(spark, sf)))


@_query
def graph_valid_edges(spark, sf):
    return graph.valid_edges(src.knowledge_point(spark, sf), src.knowledge_edge(spark, sf))


@_query
def graph_elements(spark, sf):
    points = src.knowledge_point(spark, sf)
    return graph.elements(points, graph.valid_edges(points, src.knowledge_edge(spark, sf)))


@_query
def graph_table_replace(spark, sf):
    """Points and edges of some courses replaced in one commit; of others all are taken away."""
    path, points = new_folder(spark), src.knowledge_point(spark, sf)
    edges = graph.valid_edges(points, src.knowledge_edge(spark, sf))
    sinks.save_graph(points, edges, path)
    course, even = F.col("course"), F.col("kp_id") % 2 == 0
    kept_points = points.where(course.endswith("1") & even)
    kept_edges = edges.where(course.endswith("1") & (F.col("source") % 2 == 0) & (F.col("target") % 2 == 0))
    names = points.where(course.rlike("[15]$")).select("course").distinct().collect()
    sinks.save_graph(kept_points, kept_edges, path, [r[0] for r in names])
    return graph.elements(*(committed.read_committed(spark, path, name) for name in ("points", "edges")))


@_query
def graph_id_by_name(spark, sf):
    """Ids of the points named in the prerequisite sheet."""
    names = graph.prereq_nodes(src.prereq_sheet(spark, sf)).select("name")
    points = src.knowledge_point(spark, sf).select(
        F.concat(F.lit("KP"), F.col("kp_id").cast("string")).alias("name"), F.col("kp_id").alias("id")
    )
    return graph.id_by_name(points, names)


@_query
def stage_list(spark, sf):
    return knowledge.stage_list(src.knowledge_point(spark, sf), _stages(spark, sf))


def _mastery(spark, sf, up_to=None, scores=src.student_knowledge):
    return knowledge.mastery(
        src.student(spark, sf), scores(spark, sf), src.knowledge_point(spark, sf),
        _stages(spark, sf), up_to,
    )


@_query
def mastery_overlay(spark, sf):
    return _mastery(spark, sf, "阶段2树图")


@_query
def student_point_scores(spark, sf):
    return knowledge.point_scores(
        src.student(spark, sf), src.student_knowledge(spark, sf), src.knowledge_point(spark, sf)
    )


@_query
def chapter_list(spark, sf):
    return knowledge.chapter_list(src.knowledge_point(spark, sf))


@_query
def graph_node_labels(spark, sf):
    return _nodes(spark, sf).withColumn("label", short_node(F.col("name")))


@_query
def mastery_bands(spark, sf):
    return knowledge.mastery_display(src.knowledge_point(spark, sf), _mastery(spark, sf))


@_query
def lowered_mastery_bands(spark, sf):
    """Scores of 0 read as not examined and are coloured as red ones."""
    return knowledge.mastery_display(
        src.knowledge_point(spark, sf), _mastery(spark, sf, scores=src.lowered_knowledge)
    )


def _bubbles(spark, sf, by=()):
    return knowledge.bubble_counts(
        src.knowledge_point(spark, sf), src.student_knowledge(spark, sf), src.student(spark, sf), by=by
    )


@_query
def bubble_counts(spark, sf):
    return knowledge.bubble_labels(_bubbles(spark, sf))


@_query
def bubble_counts_by_class(spark, sf):
    return knowledge.bubble_labels(_bubbles(spark, sf, REPORT_KEYS))


@_query
def class_report_text(spark, sf):
    return knowledge.class_report(_bubbles(spark, sf, REPORT_KEYS), REPORT_KEYS)


# --- degree audit ---------------------------------------------------------


def _taken(spark, sf):
    return audit.taken_courses(src.enrollment(spark, sf), src.ROW_ORDER)


@_query
def degree_audit_missing(spark, sf):
    return audit.audit_missing(_taken(spark, sf), src.required_courses(spark, sf))


@_query
def degree_audit_scores(spark, sf):
    return audit.audit_scores(_taken(spark, sf), src.required_courses(spark, sf)).orderBy(
        "student_id", "score", "course_name"
    )


@_query
def degree_audit_totals(spark, sf):
    return _rounded(audit.audit_totals(_taken(spark, sf), src.required_courses(spark, sf)), 6, "total_points")


# --- training set, statistics, features -----------------------------------


def _training(spark, sf, roles=None):
    return training.training_set(src.enrollment(spark, sf), roles or ROLES)


def _kept_training(spark, sf):
    """Written once, for queries that fit constants on the rows they change."""
    return materialise(_training(spark, sf))


@_query
def training_set(spark, sf):
    return training.expand(_training(spark, sf))


@_query
def training_set_core(spark, sf):
    return training.expand(_training(spark, sf, CORE_ROLES))


@_query
def describe_training(spark, sf):
    return _rounded(training.describe(_training(spark, sf)), 6, "mean", "std", "q25", "q50", "q75")


@_query
def correlation_matrix(spark, sf):
    return _rounded(training.correlations(_kept_training(spark, sf)), 6, "r")


@_query
def ceiling_q75(spark, sf):
    rows = training.stretch_q75(_kept_training(spark, sf))
    return _rounded(rows, 6, *(f"{c}_adj" for c in training.GRADES))


@_query
def ceiling_95(spark, sf):
    rows = _training(spark, sf).withColumn("advanced_adj", stretch_above(F.col("advanced"), 95.0))
    return _rounded(rows.select("student_id", "advanced", "weight", "advanced_adj"), 6, "advanced_adj")


@_query
def interaction_features(spark, sf):
    rows = training.interactions(training.stretch_q75(_kept_training(spark, sf)))
    names = ["base_x_advanced", "structures_minus_base"]
    return _rounded(rows.select("student_id", *training.GRADES, "weight", *names), 6, *names)


@_query
def grade_bins(spark, sf):
    rows = src.enrollment(spark, sf).select(scale_a(F.col("grade_text")).alias("score"))
    return rows.groupBy("score", score_bin(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@_query
def grade_bins_onehot(spark, sf):
    rows = training.engineered(_training(spark, sf))
    flags = [f"base_bin_{i}" for i in range(len(BIN_LABELS))]
    return rows.select("student_id", "base", "advanced", "structures", "target", "weight", *flags)


@_query
def train_test_split(spark, sf):
    return training.split(_training(spark, sf)).select("student_id", "part").distinct()


@_query
def cv_folds(spark, sf):
    return models.shuffled_folds(_training(spark, sf)).select("student_id", "fold").distinct()


@_query
def zscore_features(spark, sf):
    rows = training.split(_kept_training(spark, sf))
    scaled = training.standardise(rows, rows.where(F.col("part") == "train"), training.FEATURES)
    return _rounded(scaled, 6, *(f"{c}_z" for c in training.FEATURES))


# --- models ---------------------------------------------------------------


def _each_linear(spark, sf, report, *rounded):
    rows = models.prepared(_training(spark, sf))

    def one(name):
        return report(store.stored(rows, name), rows).withColumn("variant", F.lit(name))

    with ThreadPoolExecutor(3) as pool:  # fits of many small jobs, submitted at the same time
        results = list(pool.map(one, ("raw", "engineered", "clustered")))
    return _rounded(results[0].unionByName(results[1]).unionByName(results[2]), 4, *rounded)


@_query
def elastic_net_fit(spark, sf):
    return _each_linear(spark, sf, models.coefficients, "coefficient")


@_query
def elastic_net_metrics(spark, sf):
    return _each_linear(spark, sf, lambda model, rows: models.metrics(models.predict(model, rows)), "mse", "r2")


def _boosted(spark, sf, on):
    rows = models.prepared(_training(spark, sf))
    return store.stored(rows, "boosted", on), rows


@_query
def gbt_fit_metrics(spark, sf):
    model, rows = _boosted(spark, sf, "train")
    return models.metrics(models.predict(model, rows))


@_query
def gbt_all_metrics(spark, sf):
    """Fitted on all rows and measured on the same ones."""
    model, rows = _boosted(spark, sf, "all")
    return models.metrics(models.predict(model, rows), by=())


@_query
def feature_importance(spark, sf):
    """Of the model fitted on all rows."""
    model, rows = _boosted(spark, sf, "all")
    return models.importances(model, rows)


@_query
def kmeans_feature(spark, sf):
    rows = models.prepared(_training(spark, sf))
    steps, _, _ = models.clustered_steps(models.train_part(rows))
    clustered = rows
    for step in steps:
        clustered = step.transform(clustered)
    grouped = clustered.groupBy("cluster").agg(
        F.sum("weight").alias("n"), F.min("advanced_adj").alias("lowest"), F.max("advanced_adj").alias("highest")
    )
    return _rounded(grouped, 6, "lowest", "highest")


def _train_rows(spark, sf):
    return training.split(_training(spark, sf)).where(F.col("part") == "train").drop("part")


def _shuffled(spark, sf):
    return materialise(training.grade_tuples(models.shuffled_folds(_train_rows(spark, sf)), ["fold"]))


def _contiguous(spark, sf):
    folded = models.contiguous_folds(training.expand(_train_rows(spark, sf)))
    return materialise(training.grade_tuples(folded.withColumn("weight", F.lit(1).cast("long")), ["fold"]))


@_query
def cv_scores(spark, sf):
    scores = models.cross_validate(_shuffled(spark, sf), 5, models.raw_steps, "elastic_net", alpha=0.1)
    return _rounded(scores, 6, "r2")


@_query
def cv_scores_contiguous(spark, sf):
    scores = models.cross_validate(_contiguous(spark, sf), 5, models.raw_steps, "elastic_net", alpha=0.1)
    return _rounded(scores, 6, "r2")


@_query
def cv_scores_clustered(spark, sf):
    scores = models.cross_validate(_contiguous(spark, sf), 5, models.clustered_steps, "elastic_net", alpha=0.001)
    return _rounded(scores, 6, "r2")


@_query
def cv_scores_boosted(spark, sf):
    """Shuffled folds of the train part; the grades are stretched at the quantiles of all rows."""
    steps = models.q75_steps(models.prepared(_training(spark, sf)))
    return models.cross_validate(_shuffled(spark, sf), 5, steps, "boosted_trees", at_once=5)


def _scored(spark, sf):
    rows = models.prepared(_training(spark, sf))
    # Three digits: the solver stops within about 1e-6 of the minimum.
    return _rounded(models.diagnostics(store.stored(rows, "raw"), rows), 3, "predicted", "residual")


@_query
def batch_predict(spark, sf):
    """Students in bulk, by the saved model; whichever query comes first trains it."""
    model = store.stored(models.prepared(_training(spark, sf)), "raw")
    rows = _training(spark, sf).select("student_id", "base", "advanced", "weight")
    return _rounded(models.predict(model, rows), 3, "predicted")


@_query
def prediction_diagnostics(spark, sf):
    return _scored(spark, sf)


@_query
def residual_histogram(spark, sf):
    return models.histogram(_scored(spark, sf).where(F.col("part") == "test"))
