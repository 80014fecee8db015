"""The catalog's queries as SQL over the base tables, for checking.

Written from the definitions and not from the Spark plans: joins stay joins,
sequence numbers are window functions, retakes fan out as rows.
"""

from __future__ import annotations

import re

# Fixed values, stated here a second time: a wrong one in the engine must not reach the statements.
LABELS_A = {"优秀": 95, "良好": 85, "中等": 75, "及格": 60, "通过": 100, "不及格": 0}
LABELS_B = {"优": 95, "良": 85, "中": 75, "及格": 65, "不及格": 0, "缓考": 0}
LABELS_C = {"优秀": 95, "良好": 85, "中等": 75, "及格": 65}
NUMBER = "([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"
BIN_EDGES = [0, 60, 75, 90, 100]
BIN_LABELS = ["差", "中", "良", "优"]
STAGES = {
    "阶段1线性": ["作业1线性", "实验1", "实验2"],
    "阶段2树图": ["作业2树图", "实验3", "实验4"],
    "阶段3查找排序": ["阶段考试", "作业3查找排序"],
    "阶段4期末": ["期末考试"],
}
SCORING_ITEMS = ["作业1线性", "实验1", "实验2", "作业2树图", "实验3", "实验4", "阶段考试", "期末考试"]
SHEET_POINTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FULL_POINTS = 18
LEARNING_RATE = 0.1
ROUNDS = 100

ORDER = "academic_year, semester, l_orderkey, l_linenumber, l_partkey, l_suppkey, grade_text"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _round(expression: str, digits: int = 6) -> str:
    """Decimal half-up rounding of a double."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,14)), {digits}) AS DOUBLE)"


def _labels(grade: str, labels: dict[str, int], otherwise: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in labels.items())
    return f"CAST(CASE {grade} {cases} ELSE {otherwise} END AS DOUBLE)"


def _whole(g: str) -> str:
    lead = f"regexp_extract({g}, '^ *{NUMBER}', 1)"
    number = f"CAST(TRY_CAST(TRY_CAST({lead} AS DOUBLE) AS DECIMAL(10,0)) AS DOUBLE)"
    return f"CASE WHEN {g} IS NOT NULL THEN CASE WHEN {lead} = '' THEN 0.0 ELSE {number} END END"


def _plain(g: str) -> str:
    return f"CASE WHEN regexp_matches({g}, '^ *{NUMBER} *$') THEN TRY_CAST({g} AS DOUBLE) END"


def _a(g: str = "grade_text") -> str:
    return _labels(g, LABELS_A, _whole(g))


def _b(g: str = "grade_text") -> str:
    return _labels(g, LABELS_B, _plain(g))


def _c(g: str = "grade_text") -> str:
    return _labels(g, LABELS_C, _plain(g))


def _items(size: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{item}'" for i, item in enumerate(SCORING_ITEMS))
    return f"CASE {size} % 9 {cases} ELSE '其他' END"


def _stage(scoring: str) -> str:
    cases = " ".join(f"WHEN {scoring} IN ({_in(items)}) THEN '{stage}'" for stage, items in STAGES.items())
    return f"CASE {cases} END"


def _bin(score: str) -> str:
    limits = zip(BIN_EDGES, BIN_EDGES[1:], BIN_LABELS)
    cases = " ".join(f"WHEN {score} > {lo} AND {score} <= {hi} THEN '{name}'" for lo, hi, name in limits)
    return f"CASE {cases} END"


def _short(label: str, dots: str, tail: int) -> str:
    return f"CASE WHEN length({label}) > 8 THEN left({label}, 4) || '{dots}' || right({label}, {tail}) ELSE {label} END"


GENDER = "CASE WHEN c.c_custkey % 17 = 0 THEN NULL WHEN c.c_custkey % 2 = 0 THEN '女' ELSE '男' END"

GPA = "SUM(CAST(credit_point AS DECIMAL(18,6))) / NULLIF(SUM(CAST(credit AS DECIMAL(18,6))), 0)"

VIEWS = {
    "enrollment": f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS student_id, c.c_name AS name, n.n_name AS class_id,
  c.c_mktsegment AS major, r.r_name AS cohort, p.p_brand AS course_code, p.p_type AS course_name,
  {GENDER} AS gender,
  CASE WHEN l.l_returnflag <> 'N' THEN CAST(CAST(50 + l.l_quantity AS INT) AS VARCHAR)
       WHEN l.l_linestatus = 'F' THEN CASE l.l_linenumber WHEN 1 THEN '优秀' WHEN 2 THEN '良好'
         WHEN 3 THEN '中等' WHEN 4 THEN '及格' WHEN 5 THEN '通过' WHEN 6 THEN '不及格' ELSE '缓考' END
       ELSE CASE l.l_linenumber WHEN 1 THEN '优' WHEN 2 THEN '良' WHEN 3 THEN '中' WHEN 4 THEN '及格'
         WHEN 5 THEN '不及格' WHEN 6 THEN '缓考' ELSE '87.5' END END AS grade_text,
  CAST(EXTRACT(YEAR FROM o.o_orderdate) AS VARCHAR) AS academic_year,
  CASE WHEN EXTRACT(MONTH FROM o.o_orderdate) <= 6 THEN '2' ELSE '1' END AS semester,
  CASE WHEN o.o_orderstatus = 'P' THEN '补考' ELSE '正常考试' END AS exam_nature,
  CAST(1 + l.l_linenumber % 4 AS DOUBLE) AS credit,
  (1 + l.l_linenumber % 4) * l.l_quantity / 10 AS credit_point,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "student": f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS student_id, c.c_name AS name, c.c_mktsegment AS major,
  n.n_name AS class_id, {GENDER} AS gender
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "points": """
SELECT p_partkey AS kp_id, CONCAT(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS kp_name,
  p_type AS chapter, p_brand AS course FROM part""",
    "edges": """
SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey""",
    "sk": """
SELECT CAST(o.o_custkey AS VARCHAR) AS student_id, l.l_partkey AS kp_id,
  CAST(EXTRACT(YEAR FROM o.o_orderdate) AS VARCHAR) AS year,
  CASE WHEN l.l_returnflag = 'N' THEN -1.0 ELSE l.l_quantity * 2 END AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "scoring": f"""
SELECT p_partkey AS kp_id, y.year, {_items('p_size')} AS scoring
FROM part CROSS JOIN (SELECT '1998' AS year UNION ALL SELECT '1999' AS year) y""",
    "stages": f"SELECT kp_id, year, scoring, {_stage('scoring')} AS stage FROM scoring",
    "sheet": "SELECT student_id, "
    + ", ".join(f"MAX(CASE WHEN course_name = '{p}' THEN credit_point END) AS {p}" for p in SHEET_POINTS)
    + " FROM enrollment GROUP BY student_id",
    "prereq": """
SELECT o.o_orderkey AS row_no, o.o_orderpriority AS chapter, """
    + ", ".join(
        f"'KP' || CAST(MIN(CASE WHEN l.l_linenumber = {i} THEN l.l_partkey END) AS VARCHAR) AS k{i}" for i in range(1, 8)
    )
    + """
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority
HAVING MIN(CASE WHEN l.l_linenumber = 1 THEN l.l_partkey END) IS NOT NULL""",
    "prereq_first": """
SELECT row_no, chapter, k1, k2, k3, CASE WHEN row_no % 10 = 0 THEN ' ' ELSE k4 END AS k4, k5, k6, k7
FROM prereq QUALIFY ROW_NUMBER() OVER (PARTITION BY k1 ORDER BY row_no) = 1""",
    "mentions": " UNION ALL ".join(
        f"SELECT row_no, chapter, k1 AS level1, {i} AS pos, k{i} AS name FROM prereq_first "
        f"WHERE k{i} IS NOT NULL AND k{i} <> ' '"
        for i in range(1, 8)
    ),
    "prereq_nodes": """
SELECT name, chapter FROM mentions QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY row_no, pos) = 1""",
    "prereq_edges": "SELECT DISTINCT name AS source, level1 AS target FROM mentions WHERE pos > 1",
    "score_sheet_items": f"""
SELECT p_size AS row_no, {_items('p_size')} AS scoring, MIN(p_partkey) AS kp_1,
  MIN(p_partkey) + p_size % 3 AS kp_2, CASE WHEN p_size % 4 = 0 THEN NULL ELSE MAX(p_partkey) + 3 END AS kp_3
FROM part GROUP BY p_size""",
    "cells": " UNION ALL ".join(
        f"SELECT s.row_no, {i} AS col_no, s.scoring, p.p_partkey AS kp_id FROM score_sheet_items s "
        f"JOIN part p ON p.p_partkey = s.kp_{i}"
        for i in (1, 2, 3)
    ),
    "assigned": f"""
SELECT kp_id, '1999' AS year, scoring, {_stage('scoring')} AS stage FROM cells
QUALIFY ROW_NUMBER() OVER (PARTITION BY kp_id ORDER BY row_no, col_no) = 1""",
    "required": """
SELECT DISTINCT p_type AS course_name FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT 'THESIS' AS course_name""",
    "scored": f"SELECT *, {_a()} AS score FROM enrollment",
    "courses": f"""
SELECT course_code, course_name FROM enrollment
QUALIFY ROW_NUMBER() OVER (PARTITION BY course_code ORDER BY class_id, {ORDER}, course_name) = 1""",
    "taken": f"""
SELECT student_id, course_name, credit_point, grade_text FROM enrollment
QUALIFY ROW_NUMBER() OVER (PARTITION BY student_id, course_name ORDER BY """
    + ", ".join(f"{c} DESC" for c in f"{ORDER}, credit_point".split(", "))
    + ") = 1",
    # Class and major means: the double self-join, aggregated before joining.
    "k": """
SELECT course_name, class_id, SUM(score) AS s, COUNT(score) AS c, COUNT(*) AS n FROM scored GROUP BY ALL""",
    "m": """
SELECT course_name, major, SUM(score) AS s, COUNT(score) AS c, COUNT(*) AS n FROM scored GROUP BY ALL""",
    "matched": """
SELECT e.student_id, e.course_name, e.grade_text, e.semester, e.score, k.s * m.n AS ks, k.c * m.n AS kc,
  m.s * k.n AS ms, m.c * k.n AS mc
FROM scored e JOIN k USING (course_name, class_id) JOIN m USING (course_name, major)""",
    "home": """
SELECT student_id, course_name, grade_text, MIN(score) AS personal,
  SUM(ks) / SUM(kc) AS class_mean, SUM(ms) / SUM(mc) AS major_mean
FROM matched GROUP BY student_id, course_name, grade_text""",
    "irregular": """
SELECT * REPLACE (
  CASE WHEN l_linenumber % 2 = 1 THEN course_name || ' ' || course_code ELSE course_name END AS course_name,
  CASE WHEN CAST(student_id AS BIGINT) % 13 <> 0 THEN class_id END AS class_id,
  CASE WHEN CAST(student_id AS BIGINT) % 11 <> 0 THEN major END AS major,
  CASE WHEN course_name = 'PROMO' AND class_id LIKE '%1' OR course_name = 'SMALL' AND major = 'BUILDING'
    THEN '0' ELSE grade_text END AS grade_text)
FROM enrollment""",
    "irregular_scored": f"SELECT *, {_a()} AS score FROM irregular",
    # A student without class (or major) has no partner in the left join: one row without a score.
    "irregular_home": """
SELECT e.student_id, e.course_name, e.grade_text, MIN(e.score) AS personal,
  SUM(k.s * COALESCE(m.n, 1)) / NULLIF(SUM(k.c * COALESCE(m.n, 1)), 0) AS class_mean,
  SUM(m.s * COALESCE(k.n, 1)) / NULLIF(SUM(m.c * COALESCE(k.n, 1)), 0) AS major_mean
FROM irregular_scored e
LEFT JOIN (SELECT course_name, class_id, SUM(score) AS s, COUNT(score) AS c, COUNT(*) AS n
  FROM irregular_scored GROUP BY ALL) k ON k.course_name = e.course_name AND k.class_id = e.class_id
LEFT JOIN (SELECT course_name, major, SUM(score) AS s, COUNT(score) AS c, COUNT(*) AS n
  FROM irregular_scored GROUP BY ALL) m ON m.course_name = e.course_name AND m.major = e.major
GROUP BY ALL""",
    "subjects": """
SELECT student_id, course_name, MAX_BY(personal, grade_text) AS personal, MAX_BY(class_mean, grade_text) AS class_mean
FROM home GROUP BY student_id, course_name""",
    "means": """
SELECT student_id, course_name, AVG(score) AS actual FROM scored
WHERE course_name IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO') GROUP BY student_id, course_name""",
    "complete": "SELECT student_id FROM means GROUP BY student_id HAVING COUNT(*) = 4",
    "gains": f"""
SELECT student_id, course_name, actual, g.m + (1 - POWER(1 - {LEARNING_RATE}, {ROUNDS})) * (c.m - g.m) AS expected
FROM means JOIN complete USING (student_id)
  JOIN (SELECT course_name, AVG(actual) AS m FROM means GROUP BY course_name) c USING (course_name)
  CROSS JOIN (SELECT AVG(actual) AS m FROM means) g""",
    "lines": """
SELECT student_id, REGR_SLOPE(actual, x) AS slope, REGR_INTERCEPT(actual, x) AS icept
FROM (SELECT *, DENSE_RANK() OVER (ORDER BY course_name) - 1 AS x FROM means JOIN complete USING (student_id))
GROUP BY student_id""",
    "ts_base": "SELECT student_id, score AS base FROM scored WHERE course_name = 'ECONOMY' AND academic_year = '1998'",
    "ts_adv": "SELECT student_id, score AS advanced FROM scored WHERE course_name = 'LARGE' AND academic_year = '1998'",
    "ts_str": "SELECT student_id, score AS structures FROM scored WHERE course_name = 'MEDIUM' AND academic_year = '1999'",
    "ts_tgt": "SELECT student_id, score AS target FROM scored WHERE course_name LIKE 'PROMO%' AND academic_year = '2000'",
    "core": """
SELECT student_id, base, advanced, structures
FROM ts_base JOIN ts_adv USING (student_id) JOIN ts_str USING (student_id)""",
    "ts": """
SELECT student_id, base, advanced, structures, COALESCE(target, 0.0) AS target
FROM core LEFT JOIN ts_tgt USING (student_id)""",
    "ts_n": """
SELECT student_id, base, advanced, structures, target, COUNT(*) AS weight FROM ts GROUP BY ALL""",
    "cuts": "SELECT "
    + ", ".join(f"QUANTILE_CONT({c}, 0.75) AS q_{c}" for c in ("base", "advanced", "structures", "target"))
    + " FROM ts",
    "adjusted": "SELECT ts_n.*, "
    + ", ".join(
        f"CASE WHEN {c} >= q_{c} THEN q_{c} + SQRT({c} - q_{c}) ELSE {c} END AS {c}_adj"
        for c in ("base", "advanced", "structures", "target")
    )
    + " FROM ts_n CROSS JOIN cuts",
    "parts": """
SELECT *, CASE WHEN CAST('0x' || LEFT(MD5('split|42|' || student_id), 8) AS BIGINT) % 5 = 0
  THEN 'test' ELSE 'train' END AS part FROM ts_n""",
    "mastery": """
SELECT s.student_id, CAST(p.kp_id AS VARCHAR) AS id, p.kp_name, sk.year, sk.score, g.stage
FROM student s JOIN sk ON s.student_id = sk.student_id JOIN points p ON p.kp_id = sk.kp_id
  JOIN stages g ON g.kp_id = p.kp_id""",
    "shown": """
SELECT id, student_id, score FROM mastery WHERE stage IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY id, student_id ORDER BY stage DESC, year DESC, score DESC) = 1""",
    "lowered_shown": """
SELECT id, student_id, CASE WHEN score >= 0 THEN score - 2 ELSE score END AS score FROM shown""",
    "bubbles": """
SELECT s.class_id, p.course, p.chapter, p.kp_name, x.score, COUNT(x.student_id) AS n_students
FROM points p JOIN sk x ON x.kp_id = p.kp_id JOIN student s ON s.student_id = x.student_id
WHERE x.score <> -1 GROUP BY ALL""",
    "valid": """
SELECT a.course, e.source, e.target FROM edges e JOIN points a ON a.kp_id = e.source
  JOIN points b ON b.kp_id = e.target AND b.course = a.course""",
}


def _needs(sql: str) -> list[str]:
    """Views a statement uses, in their order; a view uses earlier ones only."""
    words = set(re.findall(r"[a-z_]+", sql))
    used = []
    for name in reversed(VIEWS):
        if name in words:
            used.insert(0, name)
            words |= set(re.findall(r"[a-z_]+", VIEWS[name]))
    return used


def _with(sql: str) -> str:
    """Prepend the views; they come before the statement's own WITH entries."""
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _needs(sql))
    own = sql.strip()
    if own.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{own[15:]}"
    return f"WITH {views}" + (f",\n{own[5:]}" if own.startswith("WITH ") else f"\n{own}")


def _scale_sql(score: str) -> str:
    return f"SELECT grade_text, {score} AS score, COUNT(*) AS n FROM enrollment GROUP BY ALL"


def _violin(score: str, where: str, source: str = "enrollment") -> str:
    return f"""SELECT * FROM (SELECT course_name AS courseName, class_id AS x, {score} AS y FROM {source}
WHERE cohort IS NOT NULL AND course_name IS NOT NULL AND major IS NOT NULL AND {where}) WHERE y IS NOT NULL"""


def _home_line(source: str, keys: str) -> str:
    return f"""SELECT {keys}course_name, grade_text, personal, {_short('course_name', '..', 2)} AS subject,
  {_round('NULLIF(class_mean, 0)')} AS class_mean, {_round('NULLIF(major_mean, 0)')} AS major_mean
FROM {source} WHERE personal IS NOT NULL"""


def _home_radar(source: str) -> str:
    return f"""SELECT student_id, course_name, grade_text, {_short('course_name', '..', 2)} AS subject,
  '个人' AS type, {_round('personal')} AS score FROM {source} WHERE personal IS NOT NULL
UNION ALL SELECT student_id, course_name, grade_text, {_short('course_name', '..', 2)}, '班级平均',
  {_round('class_mean')} FROM {source} WHERE class_mean IS NOT NULL"""


def _slope(key: str, select: str) -> str:
    return f"""SELECT {select} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {ORDER}) - 1 AS i
FROM scored WHERE score IS NOT NULL) GROUP BY {key} HAVING COUNT(*) > 1"""


def _residual(y: str, x: str = "i") -> str:
    slope = f"CASE WHEN COUNT(*) OVER w > 1 THEN REGR_SLOPE({y}, {x}) OVER w ELSE 0 END"
    line = f"{slope} * ({x} - AVG({x}) OVER w)"
    return f"{_round(f'{y} - AVG({y}) OVER w - {line}', 7)} AS {y}_residual"


_GRADES = ("base", "advanced", "structures", "target")


def _describe(c: str) -> str:
    quartiles = ", ".join(f"{_round(f'QUANTILE_CONT({c}, {q / 100})')} AS q{q}" for q in (25, 50, 75))
    return f"""SELECT '{c}' AS "column", COUNT(*) AS "count", {_round(f'AVG({c})')} AS mean,
{_round(f'STDDEV_SAMP({c})')} AS std, MIN({c}) AS min, {quartiles}, MAX({c}) AS max FROM ts"""


def _colour(prefix: str, suffixes: tuple[str, ...]) -> str:
    s = "regexp_replace(CAST(score AS VARCHAR), '\\.0$', '')"
    inverse = "regexp_replace(CAST(255.0 - score AS VARCHAR), '\\.0$', '')"
    inverse = inverse.replace("255.0 - score", "CAST(255 AS DOUBLE) - score")
    gold, red, blue, green, none = suffixes
    grey = "#9999" if prefix else "grey"
    return f"""CASE WHEN score = 100 THEN '{prefix}gold{gold}'
  WHEN score >= 0 AND score < 60 THEN '{prefix}rgb(' || {inverse} || ', ' || {s} || ', ' || {s} || '){red}'
  WHEN score >= 60 AND score < 80 THEN '{prefix}rgb(' || {s} || ', ' || {s} || ', 255){blue}'
  WHEN score >= 80 AND score < 100 THEN '{prefix}rgb(' || {s} || ', 255, ' || {s} || '){green}'
  ELSE '{prefix}{grey}{none}' END"""


def _ones(score: str) -> str:
    """Text with one decimal, halves rounded up."""
    return f"CAST(CAST(ROUND(CAST({score} AS DECIMAL(38,14)), 1) AS DECIMAL(18,1)) AS VARCHAR)"


_SQL = {
    "cohort_gpa_rank": f"""SELECT cohort, major, student_id,
  LEFT(name, 1) || REPEAT('*', CAST(LENGTH(name) - 1 AS INT)) AS name, gpa,
  ROW_NUMBER() OVER (PARTITION BY cohort, major ORDER BY gpa DESC NULLS LAST, student_id, name) AS position
FROM (SELECT cohort, major, student_id, name, {_round(GPA, 2)} AS gpa
  FROM enrollment GROUP BY cohort, major, student_id, name)""",
    "gender_distribution": "SELECT gender, COUNT(student_id) AS n_students FROM student GROUP BY gender",
    "students_by_major": f"""SELECT major, student_id, class_id, name, course_name FROM enrollment
QUALIFY ROW_NUMBER() OVER (PARTITION BY major, student_id ORDER BY {ORDER}, class_id, name, course_name) = 1""",
    "course_listing": "SELECT course_code, course_name FROM courses",
    "course_lookup": "SELECT course_code, course_name FROM courses WHERE course_code = 'Brand#3'",
    "grade_scale_a": _scale_sql(_a()),
    "grade_scale_b": _scale_sql(_b()),
    "grade_scale_c": _scale_sql(_c()),
    "violin_rough": _violin(_b(), "exam_nature LIKE '%'"),
    "violin_exam_only": _violin(_plain("grade_text"), "exam_nature LIKE '正常考试'"),
    "grade_distribution": f"""SELECT x, courseName, COUNT(*) AS n, {_round('AVG(y)')} AS mean, MIN(y) AS min,
  QUANTILE_CONT(y, 0.25) AS q25, QUANTILE_CONT(y, 0.5) AS q50, QUANTILE_CONT(y, 0.75) AS q75, MAX(y) AS max
FROM ({_violin(_b(), "exam_nature LIKE '%'")}) GROUP BY x, courseName""",
    "student_home_line": _home_line("home", "student_id, "),
    "student_home_radar": _home_radar("home"),
    "irregular_home_line": _home_line("irregular_home", "student_id, "),
    "irregular_home_radar": _home_radar("irregular_home"),
    "violin_filtered": _violin(
        _b(),
        "cohort LIKE '%A%' AND course_name LIKE '%M%' AND major LIKE '%I%' AND semester LIKE '%1%' "
        "AND academic_year LIKE '%199%' AND exam_nature LIKE '%'",
        "irregular",
    ),
    "home_pooled": _home_line(
        """(SELECT course_name, grade_text, MIN(score) AS personal, SUM(ks) / SUM(kc) AS class_mean,
  SUM(ms) / SUM(mc) AS major_mean FROM matched WHERE semester LIKE '%1%' GROUP BY course_name, grade_text)""",
        "",
    ),
    "weak_subjects": f"""SELECT student_id, course_name, personal, {_round('class_mean')} AS class_mean
FROM subjects WHERE personal < class_mean""",
    "student_report_text": f"""SELECT student_id, COUNT(*) FILTER (personal < class_mean) AS n_weak,
  'student ' || student_id
  || E'\\ngrades: ' || STRING_AGG(course_name || ' ' || {_ones('personal')}, ', ' ORDER BY course_name)
  || E'\\nclass means: ' || STRING_AGG(course_name || ' ' || {_ones('class_mean')}, ', ' ORDER BY course_name)
  || E'\\nbelow the class mean: '
  || COALESCE(STRING_AGG(course_name, ', ' ORDER BY course_name) FILTER (personal < class_mean), 'none') AS report
FROM subjects GROUP BY student_id""",
    "class_value_added": _slope(
        "class_id", f"MIN_BY(course_name, i) AS courseName, class_id AS x, {_round('REGR_SLOPE(score, i)', 9)} AS y"
    ),
    "student_value_added_slope": _slope(
        "student_id", f"student_id, {_round('REGR_SLOPE(score, i)', 9)} AS value_added"
    ),
    "semester_gpa_residuals": f"""WITH own AS (
  SELECT e.student_id, s.class_id, s.major, academic_year, semester,
  SUM(CAST(credit_point AS DECIMAL(18,6))) AS p, SUM(CAST(credit AS DECIMAL(18,6))) AS c
  FROM enrollment e JOIN student s ON s.student_id = e.student_id GROUP BY ALL),
cls AS (SELECT class_id, academic_year, semester, SUM(p) / SUM(c) AS class_gpa FROM own GROUP BY ALL),
maj AS (SELECT major, academic_year, semester, SUM(p) / SUM(c) AS major_gpa FROM own GROUP BY ALL),
numbered AS (SELECT student_id, academic_year, semester, p / c AS gpa, class_gpa, major_gpa,
  ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY academic_year, semester) - 1 AS i
  FROM own JOIN cls USING (class_id, academic_year, semester) JOIN maj USING (major, academic_year, semester))
SELECT student_id, academic_year, semester, {_round('gpa', 7)} AS gpa, {_residual('gpa')}, {_residual('class_gpa')},
  {_residual('major_gpa')} FROM numbered WINDOW w AS (PARTITION BY student_id)""",
    "course_means": f"SELECT student_id, course_name, {_round('actual')} AS actual FROM means WHERE actual IS NOT NULL",
    "course_expected_gain": f"""SELECT student_id, course_name, {_round('actual')} AS actual,
  {_round('expected')} AS expected, {_round('actual - expected')} AS gain FROM gains""",
    "course_line_residuals": f"""SELECT student_id, course_name, {_round('actual')} AS actual,
  {_round('icept + slope * x')} AS predicted, {_round('actual - icept - slope * x')} AS residual
FROM (SELECT *, DENSE_RANK() OVER (ORDER BY course_name) - 1 AS x FROM means JOIN complete USING (student_id))
  JOIN lines USING (student_id)""",
    "value_added_radar": " UNION ALL ".join(
        f"SELECT student_id, course_name AS subject, '{name}' AS type, {_round(value)} AS score FROM gains"
        for name, value in (("实际", "actual"), ("预测", "expected"), ("增值", "actual - expected"))
    ),
    "gain_report_text": """SELECT student_id,
  'student ' || student_id || E'\\n' || STRING_AGG(entry, E'\\n' ORDER BY entry) AS report
FROM (SELECT student_id, FORMAT('{}: actual {:.4f}, expected {:.4f}, gain {:.4f}',
    course_name, actual, expected, actual - expected) AS entry FROM gains)
GROUP BY student_id""",
    "unpivot_scores": " UNION ALL ".join(
        f"""SELECT student_id, (SELECT MIN(p_partkey) FROM part WHERE p_type = '{p}') AS kp_id,
'1998' AS year, {p} AS score FROM sheet"""
        for p in SHEET_POINTS
        if p != "SMALL"
    ),
    "stage_pre_year": "SELECT kp_id, year, scoring, stage FROM stages",
    "stage_assignment": "SELECT kp_id, year, scoring, stage FROM assigned",
    "stage_upsert": """SELECT kp_id, year, scoring, stage FROM stages s
WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.kp_id = s.kp_id AND a.year = s.year)
UNION ALL SELECT kp_id, year, scoring, stage FROM assigned""",
    "scoring_update": f"""SELECT p.kp_id, p.kp_name, COALESCE(w.scoring, {_items('x.p_size')}) AS scoring
FROM points p JOIN part x ON x.p_partkey = p.kp_id
LEFT JOIN (SELECT kp_id, scoring FROM cells
  QUALIFY ROW_NUMBER() OVER (PARTITION BY kp_id ORDER BY row_no DESC, col_no DESC) = 1) w ON w.kp_id = p.kp_id""",
    "prereq_edges": "SELECT source, target FROM prereq_edges",
    "prereq_nodes": "SELECT name, chapter FROM prereq_nodes",
    "prereq_node_keys": """SELECT name, chapter, '数据结构' AS course,
  CAST('0x' || LEFT(MD5('数据结构' || chr(31) || name), 15) AS BIGINT) AS kp_id FROM prereq_nodes""",
    "new_courses": "SELECT course_code, course_name FROM courses WHERE course_code NOT IN "
    "(SELECT p_brand FROM part WHERE p_brand < 'Brand#2')",
    "new_students": f"""SELECT student_id, name, major, class_id, gender FROM (SELECT * FROM enrollment
  QUALIFY ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY class_id, {ORDER}, name, major, gender NULLS FIRST) = 1)
WHERE student_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)""",
    "graph_degrees": """SELECT p.kp_id AS id,
  COALESCE(o.n, 0) AS out_degree, COALESCE(i.n, 0) AS in_degree FROM points p
LEFT JOIN (SELECT source, COUNT(*) AS n FROM edges GROUP BY source) o ON o.source = p.kp_id
LEFT JOIN (SELECT target, COUNT(*) AS n FROM edges GROUP BY target) i ON i.target = p.kp_id""",
    "graph_adjacency": """SELECT source AS id, 'successor' AS relation, target AS other FROM edges
UNION ALL SELECT target, 'predecessor', source FROM edges""",
    "graph_neighbourhood": """SELECT source AS id, target AS other FROM edges WHERE source <> target
UNION SELECT target, source FROM edges WHERE source <> target""",
    "graph_leaf_points": """SELECT source AS id FROM prereq_edges WHERE source NOT IN (SELECT target FROM prereq_edges)
GROUP BY source HAVING COUNT(*) = 1""",
    "graph_valid_edges": "SELECT course, source, target FROM valid",
    "graph_elements": """SELECT course,
  '{"data":{"id":"' || kp_id || '","name":"' || kp_name || '"}}' AS element FROM points
UNION ALL SELECT course, '{"data":{"source":"' || source || '","target":"' || target || '"}}' FROM valid""",
    "graph_id_by_name": """SELECT n.name, p_partkey AS id FROM prereq_nodes n JOIN part ON n.name = 'KP' || p_partkey""",
    "stage_list": "SELECT DISTINCT p.course, g.year, g.stage FROM stages g JOIN points p ON p.kp_id = g.kp_id",
    "mastery_overlay": "SELECT student_id, id, kp_name, year, score, stage FROM mastery WHERE stage <= '阶段2树图'",
    "student_point_scores": """SELECT s.student_id, CAST(p.kp_id AS VARCHAR) AS id, p.kp_name, sk.year, sk.score
FROM student s JOIN sk ON s.student_id = sk.student_id JOIN points p ON p.kp_id = sk.kp_id""",
    "chapter_list": "SELECT DISTINCT course, chapter FROM points",
    "graph_node_labels": """SELECT kp_id AS id, kp_name AS name,
  CASE WHEN LENGTH(kp_name) > 5 THEN LEFT(kp_name, 5) || '...' ELSE kp_name END AS label FROM points""",
    "mastery_bands": f"""SELECT CAST(p.kp_id AS VARCHAR) AS id, p.kp_name AS name, student_id, score,
  CASE WHEN score = 100 THEN 'gold' WHEN score >= 0 AND score < 60 THEN 'red' WHEN score >= 60 AND score < 80 THEN 'blue'
    WHEN score >= 80 AND score < 100 THEN 'green' ELSE 'grey' END AS band,
  {_colour('', ('', '', '', '', ''))} AS colour,
  {_colour('linear-gradient(to bottom right, ', (', white)', ', black)', ', grey)', ', antiquewhite)', ', black)'))}
    AS gradient,
  CASE WHEN score IS NULL OR score = 0 THEN '未考查'
    ELSE regexp_replace(CAST(score AS VARCHAR), '\\.0$', '') END AS shown
FROM points p JOIN (SELECT id, student_id, score FROM shown
  UNION ALL SELECT CAST(kp_id AS VARCHAR), NULL, NULL FROM points) x ON x.id = CAST(p.kp_id AS VARCHAR)""",
    "bubble_counts": f"""SELECT {_short('kp_name', '...', 4)} AS kp_name, score, n_students FROM (
  SELECT kp_name, score, CAST(SUM(n_students) AS BIGINT) AS n_students FROM bubbles GROUP BY kp_name, score)""",
    "bubble_counts_by_class": f"""SELECT class_id, course, chapter, {_short('kp_name', '...', 4)} AS kp_name, score,
  n_students FROM bubbles""",
    "class_report_text": f"""SELECT class_id, course, chapter, kp_name, score,
  kp_name || ': 得分 ' || {_ones('score')} || ', 人数 ' || n_students AS line FROM bubbles""",
    "degree_audit_missing": """SELECT s.student_id, r.course_name
FROM (SELECT DISTINCT student_id FROM enrollment) s CROSS JOIN required r
WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.student_id = s.student_id AND t.course_name = r.course_name)""",
    "degree_audit_scores": f"""SELECT student_id, course_name, grade_text, credit_point, {_c()} AS score,
  {_c()} IS NULL AND grade_text IS NOT NULL AS invalid
FROM taken WHERE course_name IN (SELECT course_name FROM required)""",
    "degree_audit_totals": f"""SELECT student_id,
  {_round('SUM(CASE WHEN course_name IN (SELECT course_name FROM required) THEN COALESCE(credit_point, 0) ELSE 0 END)')}
    AS total_points,
  COALESCE(STRING_AGG(course_name, ',' ORDER BY course_name) FILTER (credit_point = {FULL_POINTS}
    AND course_name IN (SELECT course_name FROM required)), '') AS full_courses
FROM taken GROUP BY student_id""",
    "training_set": "SELECT student_id, base, advanced, structures, target FROM ts",
    "training_set_core": "SELECT student_id, base, advanced, structures FROM core",
    "describe_training": " UNION ALL ".join(_describe(c) for c in _GRADES),
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_round(f'CORR({a}, {b})')} AS r FROM ts" for a in _GRADES for b in _GRADES
    ),
    "ceiling_q75": "SELECT student_id, base, advanced, structures, target, weight, "
    + ", ".join(f"{_round(f'{c}_adj')} AS {c}_adj" for c in _GRADES)
    + " FROM adjusted",
    "ceiling_95": f"""SELECT student_id, advanced, weight,
  {_round('CASE WHEN advanced >= 95 THEN 95 + SQRT(GREATEST(advanced - 95, 0)) ELSE advanced END')} AS advanced_adj
FROM ts_n""",
    "interaction_features": f"""SELECT student_id, base, advanced, structures, target, weight,
  {_round('base_adj * advanced_adj')} AS base_x_advanced,
  {_round('structures_adj - base_adj')} AS structures_minus_base FROM adjusted""",
    "grade_bins": f"SELECT score, {_bin('score')} AS bin, COUNT(*) AS n FROM scored GROUP BY ALL",
    "grade_bins_onehot": "SELECT student_id, base, advanced, structures, target, weight, "
    + ", ".join(
        f"CAST(COALESCE({_bin('base')} = '{label}', FALSE) AS DOUBLE) AS base_bin_{i}"
        for i, label in enumerate(BIN_LABELS)
    )
    + " FROM ts_n",
    "train_test_split": "SELECT DISTINCT student_id, part FROM parts",
    "cv_folds": """SELECT DISTINCT student_id,
  CAST(CAST('0x' || LEFT(MD5('cv|42|' || student_id), 8) AS BIGINT) % 5 AS INT) AS fold FROM ts""",
    "zscore_features": "SELECT student_id, base, advanced, structures, target, weight, part, "
    + ", ".join(f"{_round(f'({c} - m_{c}) / s_{c}')} AS {c}_z" for c in _GRADES[:3])
    + " FROM parts CROSS JOIN (SELECT "
    + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _GRADES[:3])
    + " FROM ts WHERE student_id IN (SELECT student_id FROM parts WHERE part = 'train'))",
}


# --- elastic nets: normal equations, then descent along one coordinate a step ------------

_ADV = "CASE WHEN advanced >= 95 THEN 95 + SQRT(GREATEST(advanced - 95, 0)) ELSE advanced END"
_BINS = {f"base_bin_{i}": f"base > {lo} AND base <= {hi}" for i, (lo, hi) in enumerate(((0, 60), (60, 75), (75, 90), (90, 100)))}
_CLUSTERS = {f"cluster_{i}": f"(adv > middle[1])::INT + (adv > middle[2])::INT = {i}" for i in range(3)}
_NET_FEATURES = {
    "raw": {"base": "base", "advanced": "advanced"},
    "engineered": {"base": "base", "advanced_adj": "adv", "base_x_advanced": "base * adv"} | _BINS,
    "clustered": {"base": "base", "advanced_adj": "adv", "base_x_advanced": "base * adv"} | _CLUSTERS,
}


def _net(rows: str, final: str, steps: int = 40000) -> str:
    """Elastic nets of groups of rows: (grp, variant, alpha, fit, part, base, advanced, structures, target, weight).

    ``fit`` marks the rows that a group is fitted on. Clusters are the three runs of the stretched
    grade with the least sum of squares, over every pair of cuts. ``final`` reads ``net_w`` (weights
    w of the scaled features, ybar) and ``net_pred`` (the rows with ``predicted``).
    """
    x = " ".join(
        f"WHEN '{v}' THEN [{', '.join(f'CAST({e} AS DOUBLE)' for e in f.values())}]" for v, f in _NET_FEATURES.items()
    )
    return f"""WITH RECURSIVE net_rows AS MATERIALIZED (
  SELECT *, {_ADV} AS adv, ROW_NUMBER() OVER () AS id FROM ({rows}) AS given),
runs AS MATERIALIZED (
  SELECT grp, adv, SUM(SUM(weight)) OVER w AS n, SUM(SUM(weight * adv)) OVER w AS s
  FROM net_rows WHERE fit AND variant = 'clustered' GROUP BY grp, adv WINDOW w AS (PARTITION BY grp ORDER BY adv)),
middles AS MATERIALIZED (
  SELECT grp, [(a.s / a.n + (b.s - a.s) / (b.n - a.n)) / 2, ((b.s - a.s) / (b.n - a.n) + (t.s - b.s) / (t.n - b.n)) / 2] AS middle
  FROM runs a JOIN runs b USING (grp) JOIN (SELECT grp, MAX(n) AS n, MAX_BY(s, n) AS s FROM runs GROUP BY grp) t USING (grp)
  WHERE a.adv < b.adv AND b.n < t.n
  QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY
    a.s * a.s / a.n + (b.s - a.s) * (b.s - a.s) / (b.n - a.n) + (t.s - b.s) * (t.s - b.s) / (t.n - b.n) DESC) = 1),
net_x AS MATERIALIZED (
  SELECT r.*, CASE variant {x} END AS x FROM net_rows r LEFT JOIN middles USING (grp)),
net_long AS MATERIALIZED (
  SELECT id, grp, alpha, fit, weight, structures AS y, j, x[j] AS v
  FROM (SELECT *, UNNEST(GENERATE_SERIES(1, LEN(x))) AS j FROM net_x)),
net_mean AS (SELECT grp, j, SUM(weight * v) / SUM(weight) AS m FROM net_long WHERE fit GROUP BY grp, j),
net_scale AS MATERIALIZED (
  SELECT grp, j, m, CASE WHEN SUM(weight * (v - m) * (v - m)) / SUM(weight) > 1e-12 * (1 + m * m)
    THEN SQRT(SUM(weight * (v - m) * (v - m)) / SUM(weight)) ELSE 1 END AS s
  FROM net_long JOIN net_mean USING (grp, j) WHERE fit GROUP BY grp, j, m),
net_label AS MATERIALIZED (
  SELECT grp, SUM(weight) AS n, SUM(weight * structures) / SUM(weight) AS ybar FROM net_x WHERE fit GROUP BY grp),
net_z AS MATERIALIZED (
  SELECT l.*, (v - m) / s AS z, n, ybar FROM net_long l JOIN net_scale USING (grp, j) JOIN net_label USING (grp)),
net_gram AS (
  SELECT a.grp, a.j, b.j AS k, SUM(a.weight * a.z * b.z / a.n) AS g FROM net_z a JOIN net_z b ON a.id = b.id
  WHERE a.fit GROUP BY a.grp, a.j, b.j),
net_right AS (
  SELECT grp, j, SUM(weight * z * (y - ybar) / n) AS c, ANY_VALUE(alpha) AS alpha FROM net_z WHERE fit GROUP BY grp, j),
net_system AS MATERIALIZED (
  SELECT grp, j, LIST(g ORDER BY k) AS g, ANY_VALUE(c) AS c, ANY_VALUE(alpha) AS alpha, COUNT(*) AS p
  FROM net_gram JOIN net_right USING (grp, j) GROUP BY grp, j),
net_steps AS (
  SELECT DISTINCT grp, 0 AS step, LIST_RESIZE(CAST([] AS DOUBLE[]), p, 0.0) AS w FROM net_system
  UNION ALL
  SELECT grp, step + 1,
    LIST_CONCAT(LIST_CONCAT(w[1:j - 1], [SIGN(r) * GREATEST(ABS(r) - alpha / 2, 0) / (d + alpha / 2)]), w[j + 1:])
  FROM (SELECT o.grp, step, w, e.j, e.alpha, e.g[e.j] AS d, e.c - LIST_INNER_PRODUCT(e.g, w) + e.g[e.j] * w[e.j] AS r
    FROM net_steps o JOIN net_system e ON e.grp = o.grp AND e.j = step % e.p + 1)
  WHERE step < {steps}),
net_w AS MATERIALIZED (SELECT grp, w, ybar FROM net_steps JOIN net_label USING (grp) WHERE step = {steps}),
net_pred AS (
  SELECT x.*, ANY_VALUE(net_w.ybar) + SUM(w[j] * z) AS predicted FROM net_x x JOIN net_z USING (id) JOIN net_w ON net_w.grp = x.grp
  GROUP BY ALL)
{final}"""


_NET_TUPLES = """SELECT part, base, advanced, structures, target, CAST(SUM(weight) AS BIGINT) AS weight
FROM parts GROUP BY part, base, advanced, structures, target"""


def _net_of(*variants: str) -> str:
    """The variants on the train part."""
    groups = ", ".join(f"('{v}', {'0.001' if v == 'clustered' else '0.1'})" for v in variants)
    return f"""SELECT v.variant AS grp, v.variant, v.alpha, part = 'train' AS fit, t.*
FROM ({_NET_TUPLES}) t CROSS JOIN (VALUES {groups}) AS v(variant, alpha)"""


def _net_cv(folded: str, variant: str = "raw", alpha: float = 0.1) -> str:
    """R² of every fold by a model of the others; ``folded`` has the rows with their fold."""
    rows = f"""SELECT 'fold' || k AS grp, '{variant}' AS variant, {alpha} AS alpha, fold <> k AS fit,
  CASE WHEN fold = k THEN 'out' ELSE 'in' END AS part, base, advanced, structures, target, weight, CAST(k AS INT) AS k
FROM (SELECT fold, base, advanced, structures, target, CAST(SUM(weight) AS BIGINT) AS weight FROM ({folded}) GROUP BY ALL)
CROSS JOIN GENERATE_SERIES(0, 4) AS s(k)"""
    final = f"SELECT k AS fold, {_round(_R_SQUARED)} AS r2 FROM net_pred WHERE part = 'out' GROUP BY k"
    return _net(rows, final)


_MISSES = "SUM(weight * (structures - predicted) * (structures - predicted))"
_R_SQUARED = f"""1 - {_MISSES} / (SUM(weight * structures * structures)
  - SUM(weight * structures) * SUM(weight * structures) / SUM(weight))"""
_SHUFFLED = """SELECT base, advanced, structures, target, weight,
  CAST('0x' || LEFT(MD5('cv|42|' || student_id), 8) AS BIGINT) % 5 AS fold FROM parts WHERE part = 'train'"""
# Runs of the rows in student order; the first n % 5 runs are one row longer.
_RUNS = """SELECT base, advanced, structures, target, 1 AS weight,
  CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY student_id, base, advanced, structures, target) - 1 AS i, COUNT(*) OVER () AS n
  FROM ts WHERE student_id IN (SELECT student_id FROM parts WHERE part = 'train'))"""
_NAMES = " ".join(f"WHEN '{v}' THEN [{', '.join(repr(c) for c in f)}]" for v, f in _NET_FEATURES.items())
_LINEAR = ("raw", "engineered", "clustered")

_SQL |= {
    "elastic_net_fit": _net(_net_of(*_LINEAR), f"""SELECT grp AS variant, names[j] AS feature, {_round('w[j]', 4)} AS coefficient
FROM (SELECT *, CASE grp {_NAMES} END AS names, UNNEST(GENERATE_SERIES(1, LEN(w))) AS j FROM net_w)
UNION ALL SELECT grp, '(intercept)', {_round('ybar', 4)} FROM net_w"""),
    "elastic_net_metrics": _net(_net_of(*_LINEAR), f"""SELECT variant, part, CAST(SUM(weight) AS BIGINT) AS n,
  {_round(f'{_MISSES} / SUM(weight)', 4)} AS mse, {_round(_R_SQUARED, 4)} AS r2 FROM net_pred GROUP BY variant, part"""),
    "prediction_diagnostics": _net(_net_of("raw"), f"""SELECT base, advanced, structures, target, part, weight,
  structures AS actual, {_round('predicted', 3)} AS predicted, {_round('structures - predicted', 3)} AS residual FROM net_pred"""),
    "residual_histogram": _net(_net_of("raw"), f"""SELECT CAST(CASE WHEN lo = hi THEN 1
    ELSE LEAST(20, FLOOR((residual - lo) / (hi - lo) * 20) + 1) END AS INT) AS bin, CAST(SUM(weight) AS BIGINT) AS n
FROM (SELECT residual, weight, MIN(residual) OVER () AS lo, MAX(residual) OVER () AS hi
  FROM (SELECT weight, {_round('structures - predicted', 3)} AS residual FROM net_pred WHERE part = 'test'))
GROUP BY 1"""),
    "batch_predict": _net(_net_of("raw"), f"""SELECT s.student_id, s.base, s.advanced, s.weight,
  CAST(NULL AS DOUBLE) AS actual, {_round('predicted', 3)} AS predicted
FROM parts s JOIN net_pred p USING (base, advanced, structures, target, part)"""),
    "cv_scores": _net_cv(_SHUFFLED),
    "cv_scores_contiguous": _net_cv(_RUNS),
    "kmeans_feature": _net(_net_of("clustered"), f"""SELECT
  CAST((adv > middle[1])::INT + (adv > middle[2])::INT AS INT) AS cluster, CAST(SUM(weight) AS BIGINT) AS n,
  {_round('MIN(adv)')} AS lowest, {_round('MAX(adv)')} AS highest
FROM net_rows JOIN middles USING (grp) GROUP BY 1"""),
}

_SQL["lowered_mastery_bands"] = _SQL["mastery_bands"].replace("FROM shown", "FROM lowered_shown")
_SQL["stage_table_upsert"] = _SQL["stage_upsert"]
_SQL["scoring_table_update"] = _SQL["scoring_update"]
_SQL["graph_table_replace"] = """SELECT course,
  '{"data":{"id":"' || kp_id || '","name":"' || kp_name || '"}}' AS element FROM points
WHERE course NOT LIKE '%5' AND (course NOT LIKE '%1' OR kp_id % 2 = 0)
UNION ALL SELECT course, '{"data":{"source":"' || source || '","target":"' || target || '"}}' FROM valid
WHERE course NOT LIKE '%5' AND (course NOT LIKE '%1' OR source % 2 = 0 AND target % 2 = 0)"""


_SQL["ingest_scores"] = _SQL["unpivot_scores"]
_SQL["ingest_stages"] = _SQL["stage_assignment"]
_SQL["ingest_rejected"] = "\nUNION ALL ".join(
    f"""SELECT scoring AS item, CAST(kp_{i} AS VARCHAR) AS cell, 'no such point' AS reason FROM score_sheet_items
WHERE kp_{i} IS NOT NULL AND kp_{i} NOT IN (SELECT p_partkey FROM part)"""
    for i in (1, 2, 3)
)
_KEY = "CAST('0x' || LEFT(MD5('数据结构' || chr(31) || {}), 15) AS BIGINT)"
_SQL["ingest_graph"] = f"""SELECT '数据结构' AS course,
  '{{"data":{{"id":"' || {_KEY.format('name')} || '","name":"' || name || '"}}}}' AS element FROM prereq_nodes
UNION ALL SELECT '数据结构',
  '{{"data":{{"source":"' || {_KEY.format('source')} || '","target":"' || {_KEY.format('target')} || '"}}}}' FROM prereq_edges"""


def _quarantine(scale: str, score: str, labels: tuple[str, ...]) -> str:
    number = "^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    return f"""SELECT '{scale}' AS scale, CASE WHEN reason IS NULL THEN 'good' ELSE 'bad' END AS status, reason, COUNT(*) AS n
FROM (SELECT CASE WHEN grade_text IN ({_in(labels)}) THEN NULL WHEN grade_text IS NULL THEN 'missing'
    WHEN NOT REGEXP_MATCHES(grade_text, '{number}') THEN 'no number'
    WHEN NOT REGEXP_MATCHES(grade_text, '{number} *$') THEN 'text after the number'
    WHEN {score} IS NULL OR {score} < 0 OR {score} > 100 THEN 'out of range' END AS reason FROM enrollment)
GROUP BY ALL"""


_SQL["grade_quarantine"] = "\nUNION ALL ".join((
    _quarantine("a", _a(), ("优秀", "良好", "中等", "及格", "通过", "不及格")),
    _quarantine("b", _b(), ("优", "良", "中", "及格", "不及格", "缓考")),
    _quarantine("c", _c(), ("优秀", "良好", "中等", "及格")),
))


def statements() -> dict[str, str]:
    return {name: _with(sql) for name, sql in _SQL.items()}
