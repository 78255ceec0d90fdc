"""The registered queries of the mapping engine, and the same in SQL.

The driver's tables stand in for the engine's inputs: `events` is a mapping log (a user and a key make the
pair, the event type says what was decided), `embeddings` are node vectors, `region`, `nation` and `customer`
a hierarchy, and the sales tables source data.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions import text as txt
from .functions import units
from .functions.registry import FunctionLibrary
from .operators import hierarchy, ledger, lint, shacl, translate, vectors
from .plans import mapping, materialize
from .plans.mapping import ClassRule, MappingPlan, SlotRule
from .sources import ingest, sssom
from .sources.paths import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the log ----------------------------------------------------------------------------------------------

_EVENT_JUSTIFICATION = {"signup": vocab.MMC, "purchase": vocab.HC, "error": vocab.HC}
_PREDICATE = f"CASE WHEN event_type = 'error' THEN '{vocab.DIFFERENT}' WHEN event_type = 'signup' AND event_id % 17 = 0 THEN 'skos:bogus' WHEN event_id % 2 = 0 THEN 'skos:exactMatch' WHEN event_id % 5 = 0 THEN 'skos:narrowMatch' ELSE 'skos:closeMatch' END"
_JUSTIFIED = f"CASE WHEN event_type = 'signup' THEN '{vocab.MMC}' WHEN event_type IN ('purchase', 'error') THEN '{vocab.HC}' ELSE '{vocab.COMPOSITE}' END"
_LOG = f"log AS (SELECT 'src' || (user_id % 3) || ':u' || user_id AS subject_id, {_PREDICATE} AS predicate_id, 'mc:k' || json_extract_string(props, '$.k') AS object_id, {_JUSTIFIED} AS mapping_justification, ts AS mapping_date, event_id AS log_seq FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    null = F.lit(None).cast("string")
    return e.select(
        F.expr("concat('src', user_id % 3, ':u', user_id)").alias("subject_id"), F.expr(_PREDICATE).alias("predicate_id"),
        F.concat(F.lit("mc:k"), F.get_json_object("props", "$.k")).alias("object_id"), F.expr(_JUSTIFIED).alias("mapping_justification"),
        F.lit(0.9).alias("confidence"), F.lit("").alias("subject_label"), F.lit("").alias("object_label"), F.col("ts").alias("mapping_date"),
        F.col("event_id").cast("string").alias("record_id"), *[null.alias(c) for c in vocab.MAPPING_COLUMNS[9:]], F.col("event_id").alias("log_seq"),
    )


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = _log(spark, d)
    return log.where("log_seq % 2 = 1"), log.where("log_seq % 2 = 0")


_HALVES = f"WITH {_LOG}, incoming AS (SELECT * FROM log WHERE log_seq % 2 = 1), old AS (SELECT * FROM log WHERE log_seq % 2 = 0)"


@_register(f"WITH {_LOG} SELECT subject_id, object_id, predicate_id, log_seq FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY mapping_date DESC, log_seq) AS i FROM log) WHERE i = 1 AND mapping_justification = '{vocab.HC}'")
def latest_state_per_pair(spark, d):
    return ledger.dump(_log(spark, d)).select("subject_id", "object_id", "predicate_id", "log_seq")


@_register(f"WITH {_LOG}, h AS (SELECT subject_id, object_id, max(mapping_date) AS r FROM log WHERE mapping_justification = '{vocab.HC}' GROUP BY ALL) SELECT l.subject_id, l.object_id, l.log_seq FROM log l LEFT JOIN h USING (subject_id, object_id) WHERE mapping_justification = '{vocab.MMC}' AND (r IS NULL OR mapping_date > r)")
def pending_reviews(spark, d):
    return ledger.pending(_log(spark, d)).select("subject_id", "object_id", "log_seq")


@_register(f"{_HALVES} SELECT log_seq, subject_id, object_id FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE (o.subject_id, o.predicate_id, o.object_id, o.mapping_justification) = (i.subject_id, i.predicate_id, i.object_id, i.mapping_justification))")
def append_dedup(spark, d):
    incoming, old = _halves(spark, d)
    return ledger.new_rows(incoming, old).select("log_seq", "subject_id", "object_id")


@_register(f"""{_HALVES} SELECT subject_id, object_id, 'curation without a proposal' AS error FROM incoming i WHERE mapping_justification = '{vocab.HC}' AND NOT EXISTS (SELECT 1 FROM old o WHERE o.mapping_justification = '{vocab.MMC}' AND o.subject_id = i.subject_id AND o.object_id = i.object_id)
UNION ALL SELECT subject_id, object_id, 'proposal of a curated pair' FROM incoming i WHERE mapping_justification = '{vocab.MMC}' AND EXISTS (SELECT 1 FROM old o WHERE o.mapping_justification = '{vocab.HC}' AND o.subject_id = i.subject_id AND o.object_id = i.object_id)""")
def state_violations(spark, d):
    return ledger.state_errors(*_halves(spark, d))


_HC_OLD = f"SELECT DISTINCT subject_id, object_id FROM old WHERE mapping_justification = '{vocab.HC}' AND predicate_id"


@_register(f"""{_HALVES}, a AS ({_HC_OLD} <> '{vocab.DIFFERENT}'), r AS ({_HC_OLD} = '{vocab.DIFFERENT}')
SELECT CASE WHEN a.subject_id IS NOT NULL THEN 'reproposal_of_approved' ELSE 'reproposal_of_rejected' END AS rule, i.subject_id AS source_uri, i.object_id AS target_uri, log_seq AS row_seq
FROM incoming i LEFT JOIN a USING (subject_id, object_id) LEFT JOIN r USING (subject_id, object_id) WHERE mapping_justification = '{vocab.MMC}' AND (a.subject_id IS NOT NULL OR r.subject_id IS NOT NULL)""")
def reproposals(spark, d):
    return lint.reproposals(*_halves(spark, d)).select("rule", "source_uri", "target_uri", "row_seq")


@_register(f"WITH {_LOG} SELECT subject_id AS source_uri, object_id AS target_uri, 'MaxOneMmcPerPair: ' || count(*) || ' rows for ' || subject_id || ' → ' || object_id AS message FROM log WHERE mapping_justification = '{vocab.MMC}' GROUP BY subject_id, object_id HAVING count(*) > 1")
def dup_pairs(spark, d):
    return lint.duplicate_pairs(_log(spark, d)).select("source_uri", "target_uri", "message")


@_register(f"WITH {_LOG} SELECT subject_id AS source_uri, first(object_id ORDER BY log_seq) AS target_uri, 'MaxOneMmcPerSubject: ' || subject_id || ' has ' || count(*) || ' confirmed mappings (' || string_agg(object_id, ', ' ORDER BY log_seq) || '); only one is allowed' AS message FROM log WHERE mapping_justification = '{vocab.MMC}' GROUP BY subject_id HAVING count(*) > 1")
def dup_subjects(spark, d):
    return lint.duplicate_subjects(_log(spark, d)).select("source_uri", "target_uri", "message")


_VALID = ", ".join(f"'{p}'" for p in vocab.PREDICATES)


@_register(f"WITH {_LOG} SELECT log_seq AS row_seq, 'Invalid predicate: ' || predicate_id AS message FROM log WHERE mapping_justification = '{vocab.MMC}' AND predicate_id NOT IN ({_VALID})")
def invalid_predicates(spark, d):
    return lint.invalid_predicates(_log(spark, d)).select("row_seq", "message")


@_register(f"WITH {_LOG} SELECT log_seq AS row_seq, subject_id AS source_uri FROM log WHERE mapping_justification = '{vocab.HC}'")
def hc_in_candidates(spark, d):
    return lint.curations_in_candidates(_log(spark, d)).select("row_seq", "source_uri")


@_register(f"""WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (WHERE s <> 'prefix') AS after_prefix, count(*) FILTER (WHERE s NOT IN ('prefix', 'predicate')) AS after_predicate, count(*) FILTER (WHERE s = 'accepted') AS accepted, count(*) FILTER (WHERE s = 'different_from') AS dropped_different_from
FROM (SELECT CASE WHEN predicate_id = '{vocab.DIFFERENT}' THEN 'different_from' WHEN NOT starts_with(subject_id, 'src1:') THEN 'prefix' WHEN predicate_id NOT IN ('skos:exactMatch', 'skos:closeMatch') THEN 'predicate' WHEN mapping_justification <> '{vocab.HC}' THEN 'justification' ELSE 'accepted' END AS s FROM log)""")
def staged_filter_counts(spark, d):
    return mapping.stage_counts(_log(spark, d), "src1")


# --- units and datatypes ----------------------------------------------------------------------------------

_LABELS = ["hoyde_m", "hasAltitudeFt", "speed_kmh", "range km", "rangeKm", "bearing", "signal_dbm", "mass_kg", "temp_celsius", "callsign", "distance in nautical miles", "freq_mhz", "climb in fpm", "verticalRate"]
_TYPES = ["integer", "double", "string", "float", "boolean", "long", None]
_FUNCTIONS = [None, "fns:meterToFoot", "grel:math_round", "fns:none"]


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    """One proposal a part, with labels, datatypes and functions in all combinations."""
    p = _read(spark, d, "part")

    def pick(values: list, n: str):
        cases = F.lit(None).cast("string")
        for i, v in enumerate(values):
            cases = F.when(F.expr(f"{n} % {len(values)}") == i, F.lit(v).cast("string")).otherwise(cases)
        return cases

    k, n = "p_partkey", len(_LABELS)
    null = F.lit(None).cast("string")
    told = {
        "subject_id": F.expr(f"concat('src:p', {k})"), "predicate_id": F.lit("skos:exactMatch"), "object_id": F.expr(f"concat('mc:t', {k} % 7)"), "mapping_justification": F.lit(vocab.MMC),
        "confidence": F.lit(1.0), "subject_label": pick(_LABELS, k), "object_label": pick(_LABELS, f"({k} div {n})"), "mapping_date": F.lit(None).cast("timestamp"),
        "subject_datatype": pick(_TYPES, k), "object_datatype": pick(_TYPES, f"({k} div 7)"), "conversion_function": pick(_FUNCTIONS, f"({k} div 3)"),
    }
    return p.select(*[told.get(c, null).alias(c) for c in vocab.MAPPING_COLUMNS], F.col(k).alias("log_seq"))


def _sql_unit(label: str) -> str:
    """The unit cascade of a label that is name and description at once."""
    name = f"regexp_replace({label}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    cases = [f"WHEN regexp_matches({name}, '{units.CLIMB_NAME}') AND regexp_matches({label}, '{units.CLIMB_WORDS}') THEN 'unit:FT-PER-MIN'", f"WHEN regexp_matches({name}, '{units.ANYWHERE}') THEN 'unit:KiloM-PER-HR'"]
    cases += [f"WHEN regexp_matches({name}, '(?i)(^|_)({e})$') THEN '{units.NO_IRI if u is None else 'unit:' + u}'" for e, u in units.NAME_ENDS]
    cases += [f"WHEN regexp_matches({label}, '{'' if exact else '(?i)'}\\b({w})\\b') THEN '{units.NO_IRI if u is None else 'unit:' + u}'" for w, u, exact in units.WORDS]
    return "CASE " + " ".join(cases) + " END"


_DIMS = "dims(unit, vector) AS (VALUES " + ", ".join(f"('unit:{u}', '{v}')" for v, us in units.DIMENSIONS.items() for u in us) + ")"
_LIST = f"{_sql_list(_LABELS)}"
_PROPOSED = f"""WITH {_DIMS}, labels AS (SELECT unnest({_LIST}) AS label), told AS (SELECT label, {_sql_unit('label')} AS raw FROM labels),
rows AS (SELECT p_partkey AS k, 'src:p' || p_partkey AS subject_id, 'mc:t' || (p_partkey % 7) AS object_id, {_LIST}[(p_partkey % {len(_LABELS)} + 1)::INT] AS sl, {_LIST}[(p_partkey // {len(_LABELS)} % {len(_LABELS)} + 1)::INT] AS ol,
  {_sql_list(_TYPES)}[(p_partkey % 7 + 1)::INT] AS st, {_sql_list(_TYPES)}[(p_partkey // 7 % 7 + 1)::INT] AS ot, {_sql_list(_FUNCTIONS)}[(p_partkey // 3 % 4 + 1)::INT] AS fn FROM part),
u AS (SELECT r.*, s.raw AS sraw, o.raw AS oraw, nullif(s.raw, '{units.NO_IRI}') AS su, nullif(o.raw, '{units.NO_IRI}') AS ou, ds.vector = dv.vector AS fits FROM rows r JOIN told s ON s.label = r.sl JOIN told o ON o.label = r.ol
  LEFT JOIN dims ds ON ds.unit = nullif(s.raw, '{units.NO_IRI}') LEFT JOIN dims dv ON dv.unit = nullif(o.raw, '{units.NO_IRI}'))"""
_KNOWN = "(" + ", ".join(f"'{f}'" for f in FunctionLibrary.builtins().functions) + ")"


@_register(f"{_PROPOSED} SELECT k AS log_seq, su AS subject_unit, ou AS object_unit, coalesce(sraw = '{units.NO_IRI}', false) AS subject_odd FROM u")
def detect_units(spark, d):
    label = F.col("subject_label")
    rows = _proposals(spark, d)
    return rows.select("log_seq", units.detect_unit(label, label).alias("subject_unit"), units.detect_unit(F.col("object_label"), F.col("object_label")).alias("object_unit"), units.recognised_without_iri(label, label).alias("subject_odd"))


@_register(f"{_PROPOSED} SELECT k AS log_seq, fits FROM u WHERE su IS NOT NULL AND ou IS NOT NULL")
def unit_compatibility(spark, d):
    rows = lint._with_units(_proposals(spark, d)).where("subject_unit is not null and object_unit is not null")
    return rows.select("log_seq", units.compatible(F.col("subject_unit"), F.col("object_unit")).alias("fits"))


@_register(f"""{_PROPOSED}, both_known AS (SELECT * FROM u WHERE su IS NOT NULL AND ou IS NOT NULL), part_known AS (SELECT * FROM u WHERE (su IS NULL OR ou IS NULL) AND (sraw IS NOT NULL OR oraw IS NOT NULL))
SELECT k AS row_seq, CASE WHEN NOT fits THEN 'unit_dimension_mismatch' WHEN fits IS NULL THEN 'unit_vector_missing' WHEN fn IS NULL THEN 'unit_conversion_required' WHEN fn IN {_KNOWN} THEN 'unit_conversion_covered' ELSE 'undeclared_function' END AS rule FROM both_known WHERE fits IS NULL OR NOT fits OR su <> ou
UNION ALL SELECT k, 'unit_not_detected' FROM part_known WHERE su IS NULL UNION ALL SELECT k, 'unit_not_detected' FROM part_known WHERE ou IS NULL""")
def unit_findings(spark, d):
    return lint.unit_findings(_proposals(spark, d), FunctionLibrary.builtins()).select("row_seq", "rule")


_NUM = "('integer', 'int', 'long', 'short', 'nonNegativeInteger', 'positiveInteger', 'float', 'double', 'decimal')"
_INT, _FLT = "('integer', 'int', 'long', 'short', 'nonNegativeInteger', 'positiveInteger')", "('float', 'double', 'decimal')"
_DTYPE = f"CASE WHEN st IS NULL OR ot IS NULL OR st = ot THEN NULL WHEN (st IN {_NUM}) <> (ot IN {_NUM}) THEN 'datatype_mismatch' WHEN st IN {_FLT} AND ot IN {_INT} THEN 'datatype_narrowing' END"
_COVERED = f"CASE fn WHEN 'fns:meterToFoot' THEN ot IN {_FLT} WHEN 'grel:math_round' THEN ot IN {_INT} ELSE false END"


@_register(f"""{_PROPOSED} SELECT k AS row_seq, CASE WHEN fn IS NOT NULL AND fn NOT IN {_KNOWN} THEN 'undeclared_function' WHEN fn IS NOT NULL AND {_COVERED} THEN 'datatype_covered_by_function' ELSE rule END AS rule
FROM (SELECT *, {_DTYPE} AS rule FROM u) WHERE rule IS NOT NULL""")
def datatype_findings(spark, d):
    return lint.datatype_findings(_proposals(spark, d), FunctionLibrary.builtins()).select("row_seq", "rule")


_CONV = "conv(f, t, fn, multiplier, offs) AS (VALUES " + ", ".join(f"('unit:{a}', 'unit:{b}', 'Convert{a}To{b}', {m}::DOUBLE, {'NULL' if o is None else o}::DOUBLE)" for a, b, m, o in units.CONVERSIONS) + ")"


@_register(f"{_PROPOSED}, {_CONV} SELECT subject_id, object_id, su AS subject_unit, ou AS object_unit, conv.fn, multiplier, offs AS \"offset\" FROM u LEFT JOIN conv ON su = f AND ou = t WHERE fits AND su <> ou")
def suggest_conversion(spark, d):
    return lint.suggested_conversions(_proposals(spark, d))


_POLICIES = {"integer:double": "fns:meterToFoot", "string:integer": "grel:math_round", "unit:M:unit:FT": "fns:meterToFoot", "unit:KiloGM:unit:KiloGM": "fns:kgToPound", "float:string": "fns:none"}


@_register(f"""{_PROPOSED}, pol(k2, f) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _POLICIES.items() if v != "fns:none")})
SELECT u.k AS log_seq, coalesce(u.fn, a.f, b.f) AS conversion_function FROM u LEFT JOIN pol a ON a.k2 = st || ':' || ot LEFT JOIN pol b ON b.k2 = su || ':' || ou""")
def policy_resolution(spark, d):
    return lint.populate_functions(_proposals(spark, d), _POLICIES, FunctionLibrary.builtins()).select("log_seq", "conversion_function")


@_register(f"""{_PROPOSED} SELECT count(*) FILTER (WHERE s = 'BLOCK') AS block, 0::BIGINT AS warning, count(*) FILTER (WHERE s = 'INFO') AS info FROM (
SELECT CASE WHEN fits IS NULL OR (fits AND fn IN {_KNOWN}) THEN 'INFO' ELSE 'BLOCK' END AS s FROM u WHERE su IS NOT NULL AND ou IS NOT NULL AND (fits IS NULL OR NOT fits OR su <> ou)
UNION ALL SELECT 'INFO' FROM u WHERE su IS NULL AND (ou IS NOT NULL OR sraw IS NOT NULL OR oraw IS NOT NULL) UNION ALL SELECT 'INFO' FROM u WHERE ou IS NULL AND (su IS NOT NULL OR sraw IS NOT NULL OR oraw IS NOT NULL)
UNION ALL SELECT CASE WHEN fn IS NOT NULL AND fn IN {_KNOWN} AND {_COVERED} THEN 'INFO' ELSE 'BLOCK' END FROM (SELECT *, {_DTYPE} AS rule FROM u) WHERE rule IS NOT NULL)""")
def lint_strict(spark, d):
    rows = _proposals(spark, d)
    empty = spark.createDataFrame([], vocab.LOG)
    return lint.summary(lint.run(rows, empty, library=FunctionLibrary.builtins(), strict=True))


@_register("SELECT l_orderkey, l_linenumber, round(l_quantity * 3.28084, 6) AS feet, round(l_tax * 1.8 + 32, 6) AS fahrenheit, floor(l_extendedprice)::BIGINT AS whole, round(l_quantity / 2.20462, 6) AS kilograms FROM lineitem")
def unit_convert_native(spark, d):
    lib, df = FunctionLibrary.builtins(), _read(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.round(lib.apply("fns:meterToFoot", F.col("l_quantity")), 6).alias("feet"), F.round(lib.apply("fns:celsiusToFahrenheit", F.col("l_tax")), 6).alias("fahrenheit"), lib.apply("grel:math_floor", F.col("l_extendedprice")).alias("whole"), F.round(lib.apply("fns:poundToKg", F.col("l_quantity")), 6).alias("kilograms"))


# --- ranking ----------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, d, "embeddings")
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("label") % 10 == i).cast("double"))
    left = e.where("vec_id % 10 = 0").select(F.concat(F.lit("s:"), "vec_id").alias("subject_id"), F.col("embedding").alias("vector"), hot.alias("structure"))
    right = e.where("vec_id % 10 <> 0").select(F.concat(F.lit("t:"), "vec_id").alias("object_id"), F.col("vec_id").alias("object_pos"), F.col("embedding").alias("vector"), hot.alias("structure"))
    return left, right


_PAIRS = "pairs AS (SELECT 's:' || s.vec_id AS subject_id, 't:' || t.vec_id AS object_id, t.vec_id AS pos, s.label % 10 = t.label % 10 AS same, list_cosine_similarity(s.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS cos FROM embeddings s, embeddings t WHERE s.vec_id % 10 = 0 AND t.vec_id % 10 <> 0)"


@_register(f"WITH {_PAIRS} SELECT subject_id, object_id, round(cos, 4) AS score FROM pairs WHERE round(cos, 4) >= 0.3")
def cosine_pairs(spark, d):
    left, right = (x.drop("structure") for x in _sides(spark, d))
    return vectors.similar_pairs(left, right, 0.3, digits=4)


_TOP = f"WITH {_PAIRS}, scored AS (SELECT *, {{}} AS raw FROM pairs), top AS (SELECT subject_id, object_id, round(raw, 4) AS score, row_number() OVER (PARTITION BY subject_id ORDER BY round(raw, 9) DESC, pos DESC)::INT AS rank FROM scored WHERE round(raw, 4) >= 0)"


@_register(_TOP.format("cos") + " SELECT subject_id, object_id, score, rank FROM top WHERE rank <= 5")
def topk_candidates(spark, d):
    left, right = (x.drop("structure") for x in _sides(spark, d))
    return vectors.best_candidates(left, right, 5, 0.0, digits=4)


@_register(_TOP.format("0.8 * cos + CASE WHEN same THEN 0.2 ELSE 0 END") + " SELECT subject_id, object_id, score, rank FROM top WHERE rank <= 5")
def blend_candidates(spark, d):
    return vectors.best_candidates(*_sides(spark, d), 5, 0.0, 0.2, 4)


_AS_LOG = f"dlog AS (SELECT 's:' || (user_id % 500) AS subject_id, 't:' || (event_id % 500) AS object_id, {_PREDICATE} AS predicate_id, {_JUSTIFIED} AS mapping_justification, ts AS mapping_date, event_id AS log_seq FROM events)"


def _decision_log(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(F.expr("concat('s:', user_id % 500)").alias("subject_id"), F.expr("concat('t:', event_id % 500)").alias("object_id"), F.expr(_PREDICATE).alias("predicate_id"), F.expr(_JUSTIFIED).alias("mapping_justification"), F.col("ts").alias("mapping_date"), F.col("event_id").alias("log_seq"))


_ALL_CANDIDATES = "cand AS (SELECT 's:' || s.vec_id AS subject_id, 't:' || t.vec_id AS object_id FROM embeddings s, embeddings t WHERE s.vec_id % 10 = 0 AND t.vec_id % 10 <> 0)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return vectors.paired(left.select("subject_id"), right.select("object_id"))


@_register(f"WITH {_AS_LOG}, {_ALL_CANDIDATES} SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM dlog l WHERE l.subject_id = c.subject_id AND mapping_justification = '{vocab.HC}' AND predicate_id <> '{vocab.DIFFERENT}') AND NOT EXISTS (SELECT 1 FROM dlog l WHERE l.subject_id = c.subject_id AND l.object_id = c.object_id AND mapping_justification = '{vocab.HC}' AND predicate_id = '{vocab.DIFFERENT}')")
def filter_decided(spark, d):
    return ledger.filter_decided(_candidates(spark, d), _decision_log(spark, d)).select("subject_id", "object_id")


@_register(f"""WITH {_AS_LOG}, {_ALL_CANDIDATES}, told AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY mapping_date DESC, log_seq DESC) AS i FROM dlog WHERE mapping_justification <> '{vocab.COMPOSITE}' AND NOT (mapping_justification = '{vocab.HC}' AND predicate_id = '{vocab.DIFFERENT}')) WHERE i = 1)
SELECT c.subject_id, c.object_id, coalesce(t.predicate_id, '{vocab.RELATED}') AS predicate_id, coalesce(t.mapping_justification, '{vocab.LEXICAL}') AS mapping_justification FROM cand c LEFT JOIN told t USING (subject_id, object_id)""")
def refresh_from_log(spark, d):
    return ledger.refresh(_candidates(spark, d), _decision_log(spark, d), vocab.LEXICAL).select("subject_id", "object_id", "predicate_id", "mapping_justification")


# --- hierarchy --------------------------------------------------------------------------------------------

_EDGES = "edges AS (SELECT 'r' || r_regionkey AS cls, 'world' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
_CLOSURE = f"{_EDGES}, nodes AS (SELECT cls FROM edges UNION SELECT parent FROM edges), closure AS (SELECT cls, cls AS ancestor, 0 AS dist FROM nodes UNION ALL SELECT c.cls, e.parent, c.dist + 1 FROM closure c JOIN edges e ON c.ancestor = e.cls)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    parts = [_read(spark, d, "region").selectExpr("concat('r', r_regionkey) as cls", "'world' as parent"), _read(spark, d, "nation").selectExpr("concat('n', n_nationkey) as cls", "concat('r', n_regionkey) as parent"), _read(spark, d, "customer").selectExpr("concat('c', c_custkey) as cls", "concat('n', c_nationkey) as parent")]
    return reduce(DataFrame.unionByName, parts)


@_register(f"WITH RECURSIVE {_CLOSURE} SELECT cls, ancestor, dist FROM closure")
def hierarchy_closure(spark, d):
    return hierarchy.closure(_edges(spark, d))


@_register(f"WITH RECURSIVE {_CLOSURE} SELECT cls, max(dist)::INT AS depth FROM closure GROUP BY cls")
def hierarchy_depth(spark, d):
    return hierarchy.depths(_edges(spark, d))


_MAPPED = "mapped AS (SELECT 'n' || n_nationkey AS cls FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey = 1)"


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "nation").where("n_nationkey % 3 = 0").selectExpr("concat('n', n_nationkey) as cls").unionByName(_read(spark, d, "region").where("r_regionkey = 1").selectExpr("concat('r', r_regionkey) as cls"))


_NEAREST = f"""{_CLOSURE}, {_MAPPED}, ways AS (SELECT c.cls, ancestor AS found, dist, CASE WHEN dist = 0 THEN 0 ELSE 2 END AS kind FROM closure c JOIN mapped m ON c.ancestor = m.cls UNION ALL SELECT ancestor, c.cls, dist, 1 FROM closure c JOIN mapped m ON c.cls = m.cls WHERE dist > 0),
near AS (SELECT n.cls, (SELECT found FROM ways w WHERE w.cls = n.cls ORDER BY kind, dist, found LIMIT 1) AS nearest FROM nodes n)"""


@_register(f"WITH RECURSIVE {_NEAREST} SELECT cls, nearest FROM near")
def nearest_mapped(spark, d):
    closed = hierarchy.closure(_edges(spark, d))
    return hierarchy.nearest_mapped(closed.select("cls"), _mapped(spark, d), closed)


@_register(f"WITH RECURSIVE {_NEAREST}, targets AS (SELECT DISTINCT c_mktsegment AS slot, min('c' || c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS owner FROM customer) SELECT slot, owner FROM targets JOIN near ON owner = cls WHERE nearest IS NULL")
def reachability(spark, d):
    c = _read(spark, d, "customer")
    owned = c.groupBy("c_mktsegment", "c_nationkey").agg(F.min(F.concat(F.lit("c"), "c_custkey")).alias("owner")).select(F.col("c_mktsegment").alias("slot"), "owner").distinct()
    closed = hierarchy.closure(_edges(spark, d))
    return hierarchy.unreachable(owned.select("slot").distinct(), _mapped(spark, d), owned, closed).select("slot", "owner")


@_register("SELECT p_type AS slot, first(p_brand ORDER BY p_size, p_brand) AS owner FROM part GROUP BY p_type")
def slot_owner_index(spark, d):
    return hierarchy.slot_owners(_read(spark, d, "part").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("slot"), F.col("p_size").alias("pos")))


@_register(f"""WITH RECURSIVE {_CLOSURE}, depth AS (SELECT cls, max(dist) AS depth FROM closure GROUP BY cls), uses AS (SELECT 'n' || c_nationkey AS slot, count(*) AS uses FROM customer GROUP BY ALL)
SELECT 'c' || c_custkey AS node, 1.0::DOUBLE AS f0, 1.0::DOUBLE AS f1, 0.0::DOUBLE AS f2, 0.0::DOUBLE AS f3, 0.0::DOUBLE AS f4 FROM customer
UNION ALL SELECT 'n' || n_nationkey, 0.0, round(0.5, 6), (n_nationkey % 2 = 0)::INT::DOUBLE, 0.0, round(coalesce(uses, 0) / (SELECT count(*) FROM customer), 6) FROM nation LEFT JOIN uses ON slot = 'n' || n_nationkey
UNION ALL SELECT 'r' || r_regionkey, 0.0, 0.0, 0.0, 1.0, 0.0 FROM region""")
def structural_features(spark, d):
    """Customers as classes, nations and regions as slots below one another."""
    classes = _read(spark, d, "customer").selectExpr("concat('c', c_custkey) as cls", "concat('n', c_nationkey) as parent")
    slots = _read(spark, d, "nation").selectExpr("concat('n', n_nationkey) as slot", "concat('r', n_regionkey) as parent", "n_nationkey % 2 = 0 as required", "false as multivalued").unionByName(_read(spark, d, "region").selectExpr("concat('r', r_regionkey) as slot", "cast(null as string) as parent", "false as required", "true as multivalued"))
    used = _read(spark, d, "customer").selectExpr("concat('c', c_custkey) as cls", "concat('n', c_nationkey) as slot")
    out = hierarchy.structural_features(classes, slots, used)
    return out.select("node", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(5)])


# --- plans ------------------------------------------------------------------------------------------------


@_register("SELECT l_orderkey::VARCHAR AS mapping_group_id, count(*) AS members, count(DISTINCT l_returnflag) AS exprs, count(DISTINCT l_linestatus) AS targets, min(l_returnflag) AS expr, min(l_linestatus) AS target, count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_linestatus) = 1 AS ok FROM lineitem GROUP BY l_orderkey")
def composite_groups(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("mapping_group_id"), F.col("l_returnflag").alias("composition_expr"), F.col("l_linestatus").alias("object_id"))
    return mapping.composite_groups(rows)


@_register(f"""WITH {_LOG}, src AS (SELECT DISTINCT 'u' || user_id AS name, user_id % 4 = 0 AS c, user_id % 3 = 0 AS s FROM events), mst AS (SELECT DISTINCT 'k' || json_extract_string(props, '$.k') AS name, json_extract_string(props, '$.k')::INT % 2 = 0 AS c, json_extract_string(props, '$.k')::INT % 5 <> 0 AS s FROM events)
SELECT log_seq, CASE WHEN src.c AND mst.c THEN 'class' WHEN src.s AND mst.s THEN 'slot' WHEN NOT src.c AND NOT src.s THEN 'subject' WHEN NOT mst.c AND NOT mst.s THEN 'object' ELSE 'mixed' END AS kind FROM log JOIN src ON src.name = split_part(subject_id, ':', 2) JOIN mst ON mst.name = split_part(object_id, ':', 2)""")
def classify_rows(spark, d):
    e = _read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    source = e.select(F.concat(F.lit("u"), "user_id").alias("name"), (F.col("user_id") % 4 == 0).alias("is_class"), (F.col("user_id") % 3 == 0).alias("is_slot")).distinct()
    target = e.select(F.concat(F.lit("k"), k).alias("name"), (k.cast("int") % 2 == 0).alias("is_class"), (k.cast("int") % 5 != 0).alias("is_slot")).distinct()
    return mapping.classify(_log(spark, d), source, target).select("log_seq", "kind")


@_register("SELECT DISTINCT s_nationkey::VARCHAR AS cls, c_mktsegment AS slot FROM supplier, (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT c_nationkey::VARCHAR, c_mktsegment FROM customer WHERE c_acctbal > 9500")
def required_missing(spark, d):
    c = _read(spark, d, "customer")
    segments = c.select(F.col("c_mktsegment").alias("slot")).distinct()
    need = _read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("cls")).distinct().crossJoin(F.broadcast(segments))
    return mapping.missing_required(need, c.where("c_acctbal > 9500").select(F.col("c_nationkey").cast("string").alias("cls"), F.col("c_mktsegment").alias("slot")))


MC = "https://example.org/mc#"
_PREFIXES = vocab.GLOBAL_PREFIXES | {"mc": MC, "src": "https://example.org/src/"}


def _plan(cls: str, subject: str, slots: list[SlotRule]) -> MappingPlan:
    return MappingPlan("demo", "demo", "csv", _PREFIXES, "mc", [ClassRule(cls, cls, subject, slots)], {"placedBy": "Customer"})


ORDERS = _plan("Order", f"{MC}order/$(o_orderkey)", [SlotRule("status", "o_orderstatus", datatype="string"), SlotRule("orderKey", "o_orderkey", datatype="integer"), SlotRule("priority", "o_orderpriority"), SlotRule("placedBy", "customer_iri"), SlotRule("whole", "o_totalprice", function="grel:math_floor", datatype="integer")])
CUSTOMERS = _plan("Customer", f"{MC}customer/$(c_custkey)", [SlotRule("name", "c_name"), SlotRule("segment", "c_mktsegment"), SlotRule("place", expr="[{c_nationkey},{c_mktsegment}]"), SlotRule("nation", "c_nationkey", datatype="integer")])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").withColumn("customer_iri", F.concat(F.lit(f"{MC}customer/"), "o_custkey"))


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers in one graph, with a few faults for the shapes to find."""
    graph = materialize.materialize(ORDERS, _orders(spark, d), unique_subject=True).unionByName(materialize.materialize(CUSTOMERS, _read(spark, d, "customer"), unique_subject=True))
    n = F.substring_index("s", "/", -1).cast("long")
    twice = (F.col("p") == f"{MC}segment") & (n % 45 == 0)
    graph = graph.withColumn("o", F.explode(F.when(twice, F.array("o", F.lit("SECOND"))).otherwise(F.array("o"))))
    return graph.where(~((F.col("p") == f"{MC}segment") & (n % 50 == 0)) & ~((F.col("p") == vocab.RDF_TYPE) & F.col("s").startswith(f"{MC}customer/") & (n % 40 == 0)))


def _sql_triples(key: str, table: str, cls: str, lead: str, parts: list[tuple[str, str, str, str]]) -> str:
    s = f"'{MC}{lead}/' || {key}"
    out = [f"SELECT {s} AS s, '{vocab.RDF_TYPE}' AS p, '{MC}{cls}' AS o, 'iri' AS o_kind, NULL AS o_datatype FROM {table}"]
    out += [f"SELECT {s}, '{MC}{p}', {o}, '{kind}', {t} FROM {table}" for p, o, kind, t in parts]
    return " UNION ALL ".join(out)


_XI = f"'{vocab.XSD}integer'"
_SQL_ORDERS = _sql_triples("o_orderkey", "orders", "Order", "order", [("status", "o_orderstatus", "literal", "NULL"), ("orderKey", "o_orderkey::VARCHAR", "literal", _XI), ("priority", "o_orderpriority", "literal", "NULL"), ("placedBy", f"'{MC}customer/' || o_custkey", "iri", "NULL"), ("whole", "floor(o_totalprice)::BIGINT::VARCHAR", "literal", _XI)])
_SQL_CUSTOMERS = _sql_triples("c_custkey", "customer", "Customer", "customer", [("name", "c_name", "literal", "NULL"), ("segment", "c_mktsegment", "literal", "NULL"), ("place", "'[' || c_nationkey || ',' || c_mktsegment || ']'", "literal", "NULL"), ("nation", "c_nationkey::VARCHAR", "literal", _XI)])
_SQL_GRAPH = f"""WITH g0 AS ({_SQL_ORDERS} UNION ALL {_SQL_CUSTOMERS}), g00 AS (SELECT *, regexp_extract(s, '[0-9]+$')::BIGINT AS n FROM g0),
g1 AS (SELECT * FROM g00 UNION ALL SELECT s, p, 'SECOND', o_kind, o_datatype, n FROM g00 WHERE p = '{MC}segment' AND n % 45 = 0),
g AS (SELECT * FROM g1 WHERE NOT (p = '{MC}segment' AND n % 50 = 0) AND NOT (p = '{vocab.RDF_TYPE}' AND starts_with(s, '{MC}customer/') AND n % 40 = 0)),
c AS (SELECT s FROM g WHERE p = '{vocab.RDF_TYPE}' AND o = '{MC}Customer'), o AS (SELECT s FROM g WHERE p = '{vocab.RDF_TYPE}' AND o = '{MC}Order')"""
_T = "s", "p", "o", "o_kind", "o_datatype"


@_register(f"SELECT * FROM ({_SQL_ORDERS})")
def materialize_orders(spark, d):
    return materialize.materialize(ORDERS, _orders(spark, d), unique_subject=True).select(*_T)


@_register(f"SELECT DISTINCT * FROM ({_SQL_CUSTOMERS})")
def materialize_customers(spark, d):
    return materialize.materialize(CUSTOMERS, _read(spark, d, "customer")).select(*_T)


@_register(f"SELECT '{MC}order/' || o_orderkey AS subject, o_orderstatus AS status, o_orderkey AS \"orderKey\", o_orderpriority AS priority, '{MC}customer/' || o_custkey AS \"placedBy\", floor(o_totalprice)::BIGINT AS whole FROM orders")
def typed_orders(spark, d):
    return materialize.typed_table(ORDERS, ORDERS.classes[0], _orders(spark, d))


@_register(f"SELECT DISTINCT '{MC}event/' || event_id AS s, '{MC}k' AS p, json_extract_string(props, '$.k') AS o FROM events")
def materialize_nested_json(spark, d):
    plan = _plan("Event", f"{MC}event/$(event_id)", [SlotRule("k", "$.props.k", datatype="integer")])
    rows = _read(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return materialize.materialize(plan, rows, unique_subject=True).where(F.col("p") == f"{MC}k").select("s", "p", "o")


@_register("""SELECT 'mc:customer/' || c_custkey AS id, '{"@id":"mc:customer/' || c_custkey || '","@type":"mc:Customer","mc:name":{"@value":"' || c_name || '"},"mc:nation":{"@value":"' || c_nationkey || '","@type":"xsd:integer"},"mc:place":{"@value":"[' || c_nationkey || ',' || c_mktsegment || ']"},"mc:segment":{"@value":"' || c_mktsegment || '"}}' AS node FROM customer""")
def jsonld_subjects(spark, d):
    triples = materialize.materialize(CUSTOMERS, _read(spark, d, "customer"), unique_subject=True)
    return materialize.jsonld_nodes(triples, _PREFIXES).select(txt.compact(F.col("s"), _PREFIXES).alias("id"), "node")


@_register(f"{_SQL_GRAPH} SELECT o AS segment, count(*) AS n FROM g WHERE p = '{MC}segment' GROUP BY o")
def triples_sql(spark, d):
    return materialize.query(_triples(spark, d), "SELECT o AS segment, count(*) AS n FROM triples WHERE p = :p GROUP BY o", p=f"{MC}segment")


# --- shapes -----------------------------------------------------------------------------------------------

_C, _O = {"shape": "C", "target_class": f"{MC}Customer"}, {"shape": "O", "target_class": f"{MC}Order"}
_RULES = {
    "maxCount": [_C | {"path": f"{MC}segment", "kind": "maxCount", "param": 1}],
    "minCount": [_C | {"path": f"{MC}segment", "kind": "minCount", "param": 1}],
    "datatype": [_O | {"path": f"{MC}status", "kind": "datatype", "param": f"{vocab.XSD}integer"}, _O | {"path": f"{MC}whole", "kind": "datatype", "param": f"{vocab.XSD}integer"}],
    "range": [_O | {"path": f"{MC}whole", "kind": "minInclusive", "param": 50000}, _O | {"path": f"{MC}whole", "kind": "maxExclusive", "param": 200000, "severity": "Warning"}],
    "in": [_O | {"path": f"{MC}status", "kind": "in", "items": ["O", "F"]}],
    "class": [_O | {"path": f"{MC}placedBy", "kind": "class", "param": f"{MC}Customer"}],
    "pattern": [_O | {"path": f"{MC}priority", "kind": "pattern", "param": "^[1-3]-"}],
    "hasValue": [_C | {"path": f"{MC}segment", "kind": "hasValue", "param": "BUILDING"}],
    "nodeKind": [_O | {"path": f"{MC}placedBy", "kind": "nodeKind", "param": f"{vocab.SHACL}Literal"}, _O | {"path": f"{MC}status", "kind": "nodeKind", "param": f"{vocab.SHACL}Literal"}],
    "closed": [_C | {"kind": "closed", "param": "true", "items": [vocab.RDF_TYPE]}, _C | {"path": f"{MC}name", "kind": "maxCount", "param": 1}, _C | {"path": f"{MC}segment", "kind": "maxCount", "param": 2}, _C | {"path": f"{MC}nation", "kind": "nodeKind", "param": f"{vocab.SHACL}Literal"}],
}


def _check(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return shacl.findings(_triples(spark, d), shacl.constraints(spark, [r for n in names for r in _RULES[n]]))


_F = "focus", "path", "constraint", "value"
_SHACL_SQL = {
    "maxCount": f"SELECT s AS focus, '{MC}segment' AS path, 'maxCount' AS \"constraint\", count(*)::VARCHAR AS value, 'Violation' AS severity FROM g SEMI JOIN c USING (s) WHERE p = '{MC}segment' GROUP BY s HAVING count(*) > 1",
    "minCount": f"SELECT s AS focus, '{MC}segment' AS path, 'minCount' AS \"constraint\", '0' AS value, 'Violation' AS severity FROM c WHERE s NOT IN (SELECT s FROM g WHERE p = '{MC}segment')",
    "datatype": f"SELECT s AS focus, p AS path, 'datatype' AS \"constraint\", o AS value, 'Violation' AS severity FROM g SEMI JOIN o USING (s) WHERE p = '{MC}status'",
    "range": f"SELECT s AS focus, p AS path, k AS \"constraint\", o AS value, sev AS severity FROM g SEMI JOIN o USING (s), (VALUES ('minInclusive', 'Violation'), ('maxExclusive', 'Warning')) v(k, sev) WHERE p = '{MC}whole' AND ((k = 'minInclusive' AND try_cast(o AS DOUBLE) < 50000) OR (k = 'maxExclusive' AND try_cast(o AS DOUBLE) >= 200000))",
    "in": f"SELECT s AS focus, p AS path, 'in' AS \"constraint\", o AS value, 'Violation' AS severity FROM g SEMI JOIN o USING (s) WHERE p = '{MC}status' AND o NOT IN ('O', 'F')",
    "class": f"SELECT s AS focus, p AS path, 'class' AS \"constraint\", o AS value, 'Violation' AS severity FROM g SEMI JOIN o USING (s) WHERE p = '{MC}placedBy' AND o NOT IN (SELECT s FROM c)",
    "pattern": f"SELECT s AS focus, p AS path, 'pattern' AS \"constraint\", o AS value, 'Violation' AS severity FROM g SEMI JOIN o USING (s) WHERE p = '{MC}priority' AND NOT regexp_matches(o, '^[1-3]-')",
    "hasValue": f"SELECT s AS focus, '{MC}segment' AS path, 'hasValue' AS \"constraint\", 'BUILDING' AS value, 'Violation' AS severity FROM c WHERE s NOT IN (SELECT s FROM g WHERE p = '{MC}segment' AND o = 'BUILDING')",
    "nodeKind": f"SELECT s AS focus, p AS path, 'nodeKind' AS \"constraint\", o AS value, 'Violation' AS severity FROM g SEMI JOIN o USING (s) WHERE p = '{MC}placedBy'",
    "closed": f"SELECT s AS focus, p AS path, 'closed' AS \"constraint\", o AS value, 'Violation' AS severity FROM g SEMI JOIN c USING (s) WHERE p = '{MC}place'",
}


def _shacl_query(name: str):
    def run(spark, d):
        return _check(spark, d, name).select(*_F)

    run.__name__ = f"shacl_{name.lower()}"
    return run


for _name, _sql in _SHACL_SQL.items():
    _register(f"{_SQL_GRAPH} SELECT focus, path, \"constraint\", value FROM ({_sql})")(_shacl_query(_name))


@_register(f"{_SQL_GRAPH} SELECT count(*) FILTER (WHERE severity = 'Violation') AS violation, count(*) FILTER (WHERE severity = 'Warning') AS warning, 0::BIGINT AS info, count(*) = 0 AS conforms FROM ({' UNION ALL '.join(f'({q})' for q in _SHACL_SQL.values())})")
def shacl_report(spark, d):
    rules = [r for n, rs in _RULES.items() for r in rs if n != "closed" or r["kind"] in ("closed", "nodeKind")]
    rules += [_C | {"path": f"{MC}{p}", "kind": "minCount", "param": 0} for p in ("name", "segment")]
    return shacl.report(shacl.findings(_triples(spark, d), shacl.constraints(spark, rules)))


@_register(f"""{_PROPOSED} SELECT object_id AS cls, string_agg(su, ' ' ORDER BY f, su) AS units FROM (SELECT object_id, su, min(k) AS f FROM u WHERE su IS NOT NULL GROUP BY ALL) GROUP BY object_id""")
def shacl_gen_units(spark, d):
    rows = _proposals(spark, d)
    found = rows.select(F.col("object_id").alias("cls"), F.col("subject_id").alias("slot"), F.col("log_seq").alias("pos"), units.detect_unit(F.col("subject_label"), F.col("subject_label")).alias("unit"))
    return shacl.class_units(found).select("cls", F.array_join("units", " ").alias("units"))


# --- schemas and texts ------------------------------------------------------------------------------------


@_register("""SELECT 's_suppkey' AS "column", 'integer' AS "range", count(*) = count(DISTINCT s_suppkey) AS "unique" FROM supplier UNION ALL SELECT 's_name', 'string', count(*) = count(DISTINCT s_name) FROM supplier
UNION ALL SELECT 's_nationkey', 'integer', count(*) = count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 's_acctbal', 'float', count(*) = count(DISTINCT s_acctbal) FROM supplier""")
def schema_profile(spark, d):
    found = ingest.profile(_read(spark, d, "supplier"))
    return spark.createDataFrame([(c, p["range"], p["unique"]) for c, p in found.items()], "column string, range string, unique boolean")


@_register("SELECT p_partkey, 'part:' || p_partkey AS node_id, 'Large ' || p_brand || '. ' || p_type AS text, regexp_replace(p_brand, '^[^#]*#', '') AS local FROM part")
def text_projection(spark, d):
    return _read(spark, d, "part").select("p_partkey", F.concat(F.lit("part:"), "p_partkey").alias("node_id"), F.concat_ws(". ", F.concat(txt.title_label(F.lit("lARGE_")), F.col("p_brand")), "p_type").alias("text"), txt.local_name(F.regexp_replace("p_brand", "#", ":")).alias("local"))


_DICTIONARY = [("FRANCE", "Frankreich"), ("GERMANY", "Deutschland"), ("EGYPT", "Ägypten"), ("N1", "Land eins")]


@_register(f"""WITH dict(t, x) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _DICTIONARY)}), n AS (SELECT n_nationkey, n_name AS title, 'N' || n_regionkey AS description FROM nation)
SELECT n_nationkey, coalesce(a.x, title) AS title, coalesce(b.x, description) AS description, CASE WHEN a.x IS NOT NULL AND a.x <> title THEN title ELSE '' END AS aliases FROM n LEFT JOIN dict a ON a.t = title LEFT JOIN dict b ON b.t = description""")
def translate_apply(spark, d):
    nodes = _read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title"), F.expr("concat('N', n_regionkey)").alias("description"), F.array().cast("array<string>").alias("aliases"))
    words = spark.createDataFrame(_DICTIONARY, "text string, translated string")
    return translate.apply(nodes, words).withColumn("aliases", F.array_join("aliases", ","))


@_register(f"WITH {_LOG} SELECT log_seq, '{MC}' || split_part(object_id, ':', 2) AS iri, object_id AS curie, split_part(subject_id, ':', 2) AS local FROM log")
def curie_expand(spark, d):
    iri = txt.expand(F.col("object_id"), _PREFIXES)
    return _log(spark, d).select("log_seq", iri.alias("iri"), txt.compact(iri, _PREFIXES).alias("curie"), txt.local_name(F.col("subject_id")).alias("local"))


@_register("SELECT n_nationkey, 'http://x/' || replace(n_name, ' ', '%20') || '/' || n_nationkey AS iri FROM nation")
def iri_templates(spark, d):
    n = _read(spark, d, "nation")
    return n.select("n_nationkey", txt.template("http://x/$(n_name)/$(n_nationkey)", {c: F.col(c) for c in n.columns}).alias("iri"))


@_register()
def sssom_roundtrip(spark, d):
    """All decided pairs written as mapping files and read back, each compared with what was written."""
    rows = ledger.dump(_log(spark, d))
    path = f"{shared_dir(spark)}/strandweave-sssom-{uuid.uuid4().hex}/log.sssom.tsv"
    sssom.write(rows, path, ["a mapping set"])
    back = sssom.read(spark, path)
    columns = vocab.MAPPING_COLUMNS
    both = rows.select(*columns, F.lit(1).alias("n")).unionByName(back.select(*columns, F.lit(-1).alias("n")))
    if not both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0").isEmpty():
        raise ValueError(f"{path}: the rows read back are not those written")
    return back


from . import document_queries  # noqa: E402, F401  # they register themselves
