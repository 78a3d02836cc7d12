"""Queries over scans, columns, gaps, scaling and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from penstock.functions.draws import uniform_sql
from penstock.operators import columns as C
from penstock.operators import impute, profile, scale
from penstock.operators.ordering import quantiles, with_row_id
from penstock.plans.inputs import (
    LINE_ITEMS,
    MEASURES,
    MEASURES_SQL,
    READINGS,
    SENSOR_WIDE,
    SENSORS,
    line_items,
    measures,
    readings,
    rounded,
    sensor_wide,
    table,
    unpivot_sql,
)
from penstock.plans.registry import query
from penstock.session import scratch_path
from penstock.sources import csvfiles
from penstock.sources.staging import load_quartet, materialize, save_quartet, stage

# ---------------------------------------------------------------- scans and sinks


_LINE_PROFILE = """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity,
       round(min(l_extendedprice), 6) AS min_price, round(max(l_extendedprice), 6) AS max_price
FROM lineitem GROUP BY l_returnflag"""


def _line_profile(df):
    return rounded(
        df.groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity"),
            F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"),
        ),
        "mean_quantity", "min_price", "max_price",
    )


@query("s1_csv_scan", _LINE_PROFILE)
def s1_csv_scan(spark, sf_dir):
    """Write the line items as CSV with a header, scan them back with a declared schema."""
    path = scratch_path(spark, "s1-csv")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    csvfiles.write_csv(li, path)
    return _line_profile(csvfiles.read_csv(spark, path, li.schema))


@query("s1_csv_scan_inferred", _LINE_PROFILE)
def s1_csv_scan_inferred(spark, sf_dir):
    """The same scan with inferred types."""
    path = scratch_path(spark, "s1-csv")
    csvfiles.write_csv(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag"), path)
    return _line_profile(csvfiles.read_csv(spark, path))


@query(
    "s2_csv_banner_scan",
    """SELECT count(*) AS n, count(value) AS n_value, count(DISTINCT event_type) AS sensors,
              round(avg(value), 6) AS mean_value FROM events""",
)
def s2_csv_banner_scan(spark, sf_dir):
    """Files whose first line is a banner and whose second line is the header."""
    path = scratch_path(spark, "s2-csv")
    names = ["event_id", "event_type", "value"]
    body = table(spark, sf_dir, "events").select(*[F.col(c).cast("string") for c in names])
    header = spark.createDataFrame([tuple(names)], ", ".join(f"{n} string" for n in names))
    csvfiles.write_csv(header.unionByName(body).toDF("plant export", "b", "c"), path)
    cells = csvfiles.read_text_table(spark, path, names, banner=True)
    return rounded(
        cells.agg(
            F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"),
            F.count_distinct("event_type").alias("sensors"), F.avg(F.col("value").try_cast("double")).alias("mean_value"),
        ),
        "mean_value",
    )


@query(
    "s3_preview",
    """SELECT 'lineitem' AS table_name, 1000 AS asked, least(1000, count(*)) AS got, 11 AS n_columns FROM lineitem
       UNION ALL SELECT 'events', 1, least(1, count(*)), 6 FROM events""",
)
def s3_preview(spark, sf_dir):
    """Bounded previews; which rows come first is up to the file."""
    out = None
    for name, rows in (("lineitem", 1000), ("events", 1)):
        seen = csvfiles.preview(table(spark, sf_dir, name), rows)
        one = seen.agg(F.count(F.lit(1)).alias("got")).select(
            F.lit(name).alias("table_name"), F.lit(rows).alias("asked"), "got", F.lit(len(seen.columns)).alias("n_columns")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s4_chunked_scan",
    f"""WITH {MEASURES_SQL}
    SELECT row_id // 50000 AS chunk, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM li GROUP BY 1""",
)
def s4_chunked_scan(spark, sf_dir):
    """Rows per chunk of 50,000 in key order."""
    li = measures(spark, sf_dir)
    chunk = F.floor(F.col("row_id") / impute.CHUNK_ROWS).cast("long")
    return rounded(
        li.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity")),
        "mean_quantity",
    )


@query(
    "s5_attach_labels",
    """SELECT lang, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars
       FROM documents JOIN labels USING (doc_id) GROUP BY lang, toxic""",
)
def s5_attach_labels(spark, sf_dir):
    """Label side table joined on the row key; only labelled rows take part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    joined = C.attach_labels(known, labels, "doc_id")
    return rounded(
        joined.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars")), "mean_chars"
    )


@query(
    "s6_label_resolution",
    """SELECT 'label' AS rule, sum(label)::BIGINT AS total FROM embeddings
       UNION ALL SELECT 'last', sum(toxic)::BIGINT FROM labels
       UNION ALL SELECT 'first', sum(doc_id)::BIGINT FROM labels""",
)
def s6_label_resolution(spark, sf_dir):
    """Label by name, else last column, else (other rule) first column."""
    named = C.resolve_label(table(spark, sf_dir, "embeddings"))
    last = C.resolve_label(table(spark, sf_dir, "labels"))
    first = C.resolve_label(table(spark, sf_dir, "labels"), names=("attack",), fallback="first")
    out = None
    for rule, df in (("label", named), ("last", last), ("first", first)):
        one = df.agg(F.sum("label").cast("long").alias("total")).select(F.lit(rule).alias("rule"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("s7_csv_sink", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def s7_csv_sink(spark, sf_dir):
    """Write the readings as CSV, then aggregate what arrived."""
    path = scratch_path(spark, "s7-csv")
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    csvfiles.write_csv(df, path)
    back = csvfiles.read_csv(spark, path, df.schema)
    return rounded(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query(
    "s8_persisted_scaler",
    f"""WITH stats AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS position, min({c}) AS lo, max({c}) AS hi, avg({c}) AS mean FROM lineitem"
        for i, c in enumerate(MEASURES))})
    SELECT feature, position, round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 4) AS mean FROM stats""",
)
def s8_persisted_scaler(spark, sf_dir):
    """Scaler state and feature list, written and loaded again."""
    path = scratch_path(spark, "scaler")
    scale.save_params(scale.fit_params(table(spark, sf_dir, "lineitem"), MEASURES), path)
    back = scale.load_params(spark, path).select("feature", "position", "min", "max", "mean")
    return rounded(rounded(back, "min", "max"), "mean", digits=4)


@query("s9_stage_once", "SELECT count(*) AS n, count(*) AS n_again, true AS kept FROM events")
def s9_stage_once(spark, sf_dir):
    """The second materialisation of a stage is skipped: it keeps the first content."""
    path = scratch_path(spark, "s9")
    e = table(spark, sf_dir, "events").select("event_id")
    first = materialize(e, path).agg(F.count(F.lit(1)).alias("n"))
    again = materialize(e.filter("event_id < 0"), path).agg(F.count(F.lit(1)).alias("n_again"))
    both = first.withColumn("n_again", F.lit(again.first()["n_again"]))
    return both.withColumn("kept", F.col("n") == F.col("n_again"))


@query(
    "s10_reload_quartet",
    f"""WITH {LINE_ITEMS}
    SELECT CASE WHEN l_linestatus = 'F' THEN 'x_train' ELSE 'x_test' END AS name, count(*) AS n FROM lk GROUP BY 1
    UNION ALL SELECT CASE WHEN l_linestatus = 'F' THEN 'y_train' ELSE 'y_test' END, count(*) FROM lk GROUP BY 1""",
)
def s10_reload_quartet(spark, sf_dir):
    """Features and labels of both splits, saved and reloaded."""
    li = line_items(spark, sf_dir)
    sides = {"train": li.filter("l_linestatus = 'F'"), "test": li.filter("l_linestatus <> 'F'")}
    tables = {f"x_{s}": df.select("row_key", *MEASURES) for s, df in sides.items()}
    tables |= {f"y_{s}": df.select("row_key", (F.col("l_returnflag") == "R").cast("int").alias("label")) for s, df in sides.items()}
    folder = scratch_path(spark, "quartet")
    save_quartet(tables, folder)
    out = None
    for name, df in load_quartet(spark, folder).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- columns and labels


def _dated(spark, sf_dir):
    """Readings with the awkward names of a plant export."""
    e = readings(spark, sf_dir)
    return e.select(
        F.col("sec").alias("Time"), F.col("minute").alias("TIMESTAMP"), F.col("event_id").alias("row"),
        (F.col("event_type") == "error").cast("int").alias("Attack"), "value", F.col("user_id").cast("double").alias("attack_x"),
        F.col("event_type").alias("tag"),
    )


def _column_summary(df):
    """(column, n, mean) of the numeric columns that are left."""
    return rounded(
        profile.column_stats(df, df.columns).select("feature", "rows", "mean"), "mean"
    )


@query(
    "p1_drop_non_features",
    f"""WITH {READINGS}, e AS (SELECT value, user_id::DOUBLE AS attack_x FROM ev), long AS (
        {unpivot_sql(["value", "attack_x"], "e")})
    SELECT feature, count(*) AS rows, round(avg(value), 6) AS mean FROM long GROUP BY feature""",
)
def p1_drop_non_features(spark, sf_dir):
    """Time, row and label columns leave whatever their case."""
    return _column_summary(C.drop_non_features(_dated(spark, sf_dir)).drop("tag"))


@query(
    "p2_drop_non_sensors",
    f"""WITH {READINGS}, e AS (SELECT minute::DOUBLE AS "TIMESTAMP", event_id::DOUBLE AS "row",
          CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS "Attack", value, user_id::DOUBLE AS attack_x FROM ev),
        long AS ({unpivot_sql(["TIMESTAMP", "row", "Attack", "value", "attack_x"], "e")})
    SELECT feature, count(*) AS rows, round(avg(value), 6) AS mean FROM long GROUP BY feature""",
)
def p2_drop_non_sensors(spark, sf_dir):
    """Only exact spellings leave."""
    return _column_summary(C.drop_non_sensors(_dated(spark, sf_dir)).drop("tag"))


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES)


@query(
    "p3_numeric_only",
    f"""WITH long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM lineitem" for c in _NUMERIC)})
    SELECT feature, count(*) AS rows, round(avg(value), 3) AS mean FROM long GROUP BY feature""",
)
def p3_numeric_only(spark, sf_dir):
    """Numeric columns of a mixed table."""
    df = C.numeric_only(table(spark, sf_dir, "lineitem"))
    return rounded(profile.column_stats(df, df.columns).select("feature", "rows", "mean"), "mean", digits=3)


@query(
    "p4_drop_denied",
    f"""WITH {READINGS}, deny AS (SELECT unnest([{", ".join(repr(n) for n in C.DENY_LIST)}]) AS name),
    cols AS (SELECT unnest(['1_FIT_001_PV', '2_LT_001_PV', '2_SV_101_STATUS']) AS name),
    long AS (SELECT 'found' AS what, (SELECT count(*) FROM deny WHERE name IN (SELECT name FROM cols)) AS n
      UNION ALL SELECT 'missing', (SELECT count(*) FROM deny WHERE name NOT IN (SELECT name FROM cols))
      UNION ALL SELECT 'kept', (SELECT count(*) FROM cols WHERE name NOT IN (SELECT name FROM deny)))
    SELECT what, n::BIGINT AS n, (SELECT count(*) FROM ev) AS rows,
           (SELECT round(avg(value), 6) FROM ev) AS mean_kept FROM long""",
)
def p4_drop_denied(spark, sf_dir):
    """Deny-listed sensors that are present leave; the report counts found and missing names."""
    e = readings(spark, sf_dir)
    df = e.select(
        F.col("value").alias("1_FIT_001_PV"), F.col("value").alias("2_LT_001_PV"), F.lit(1.0).alias("2_SV_101_STATUS")
    )
    found, missing = C.split_deny_list(df.columns)
    kept = C.drop_denied(df)
    stats = kept.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("`1_FIT_001_PV`")).alias("mean_kept"))
    counts = [("found", len(found)), ("missing", len(missing)), ("kept", len(kept.columns))]
    entries = F.array(*[F.struct(F.lit(w).alias("what"), F.lit(n).cast("long").alias("n")) for w, n in counts])
    return rounded(stats.select(F.explode(entries).alias("e"), "rows", "mean_kept").select("e.*", "rows", "mean_kept"), "mean_kept")


# Minutes of the sensor table that count as the settling time in the queries.
SETTLING_ROWS = 360


@query(
    "p5_drop_leading_rows",
    f"""WITH {SENSOR_WIDE} SELECT row_id, minute FROM wide WHERE row_id >= {SETTLING_ROWS}""",
)
def p5_drop_leading_rows(spark, sf_dir):
    """Settling rows leave by row id."""
    return C.drop_leading(sensor_wide(spark, sf_dir), SETTLING_ROWS).select("row_id", "minute")


@query(
    "p6_align_columns",
    """SELECT 'train' AS side, 0 AS position, 'l_tax' AS feature, round(avg(l_tax), 6) AS mean FROM lineitem WHERE l_linestatus = 'F'
       UNION ALL SELECT 'train', 1, 'l_quantity', round(avg(l_quantity), 6) FROM lineitem WHERE l_linestatus = 'F'
       UNION ALL SELECT 'test', 0, 'l_tax', round(avg(l_tax), 6) FROM lineitem WHERE l_linestatus <> 'F'
       UNION ALL SELECT 'test', 1, 'l_quantity', round(avg(l_quantity), 6) FROM lineitem WHERE l_linestatus <> 'F'""",
)
def p6_align_columns(spark, sf_dir):
    """Common columns in train order."""
    li = table(spark, sf_dir, "lineitem")
    train = li.filter("l_linestatus = 'F'").select("l_tax", "l_discount", "l_quantity")
    test = li.filter("l_linestatus <> 'F'").select("l_quantity", "l_tax", "l_extendedprice")
    out = None
    for side, df in zip(("train", "test"), C.align(train, test)):
        order = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("feature")) - 1
        one = profile.column_stats(df, df.columns).select(
            F.lit(side).alias("side"), order.cast("int").alias("position"), "feature", "mean"
        )
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean")


@query(
    "p7_drop_all_null",
    f"""WITH {SENSOR_WIDE} SELECT 'click' AS feature, count(click) AS n FROM wide UNION ALL SELECT 'error', count("error") FROM wide""",
)
def p7_drop_all_null(spark, sf_dir):
    """A column empty in either table leaves both."""
    df = sensor_wide(spark, sf_dir, with_id=False)
    nothing = F.lit(None).cast("double")
    train = df.select("click", "error", nothing.alias("view"), "signup")
    test = df.select("click", "error", "view", nothing.alias("signup"))
    gone = profile.all_null_columns(train, test, train.columns)
    kept = [c for c in train.columns if c not in gone]
    return profile.column_stats(train.select(*kept), kept).select("feature", (F.col("rows") - F.col("nulls")).alias("n"))


@query(
    "p8_split_last_column",
    "SELECT toxic AS label, count(*) AS n, sum(quality)::BIGINT AS quality FROM labels GROUP BY toxic",
)
def p8_split_last_column(spark, sf_dir):
    """The last column becomes the label and leaves the features."""
    features, labels = C.split_last_column(table(spark, sf_dir, "labels"), "doc_id")
    return C.attach_labels(features, labels, "doc_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("quality")
    )


_CODES = "CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 END"


@query(
    "p9_recode_labels",
    f"""SELECT {_CODES} AS raw, CASE WHEN {_CODES} = 1 THEN 0 ELSE 1 END AS signed,
              CASE WHEN {_CODES} = 0 THEN 0 ELSE 1 END AS nonzero, count(*) AS n FROM events GROUP BY ALL""",
)
def p9_recode_labels(spark, sf_dir):
    """Both label codes, NULL counting as attack."""
    raw = F.expr(_CODES)
    e = table(spark, sf_dir, "events").select(raw.alias("raw"))
    coded = e.select("raw", C.attack_from_signed(F.col("raw")).alias("signed"), C.attack_from_nonzero(F.col("raw")).alias("nonzero"))
    return coded.groupBy("raw", "signed", "nonzero").agg(F.count(F.lit(1)).alias("n"))


@query("p10_constant_label", f"WITH {SENSOR_WIDE} SELECT 0 AS label, count(*) AS n FROM wide WHERE attack = 0")
def p10_constant_label(spark, sf_dir):
    """Training rows are all normal."""
    normal = sensor_wide(spark, sf_dir, with_id=False).filter("attack = 0")
    return normal.withColumn("label", F.lit(0)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p11_split_by_class",
    f"""WITH {SENSOR_WIDE} SELECT attack AS label, count(*) AS n, round(avg("view"), 6) AS mean_view FROM wide GROUP BY attack""",
)
def p11_split_by_class(spark, sf_dir):
    """Rows of each class on their own."""
    df = sensor_wide(spark, sf_dir, with_id=False).withColumnRenamed("attack", "label")
    out = None
    for value in (0, 1):
        one = df.filter(F.col("label") == value).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("view").alias("mean_view"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean_view")


_DIRTY = """CASE WHEN event_id % 7 = 3 THEN 'bad' WHEN event_id % 7 = 4 THEN NULL WHEN event_id % 11 = 5 THEN 'NaN'
 ELSE event_id % 100 || '.5' END"""
_DIRTY_SPARK = """CASE WHEN event_id % 7 = 3 THEN 'bad' WHEN event_id % 7 = 4 THEN NULL WHEN event_id % 11 = 5 THEN 'NaN'
 ELSE concat(event_id % 100, '.5') END"""


@query(
    "p14_coerce_after_fill",
    f"""WITH d AS (SELECT event_id, CASE WHEN cell = 'NaN' THEN NULL ELSE cell END AS cell
                   FROM (SELECT event_id, {_DIRTY} AS cell FROM events)),
    f AS (SELECT event_id, last_value(cell IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS fw,
                 first_value(cell IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bw FROM d)
    SELECT event_id, coalesce(TRY_CAST(coalesce(fw, bw) AS DOUBLE), 0.0) AS value FROM f""",
)
def p14_coerce_after_fill(spark, sf_dir):
    """Fills run on the text cells, then the cells become numbers: a bad cell and the gap after it become 0."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_DIRTY_SPARK).alias("cell"))
    e = e.withColumn("cell", F.when(~F.col("cell").isin(*csvfiles.MISSING_TOKENS), F.col("cell")))
    filled = impute.ordered_fill(with_row_id(e, ["event_id"]), ["cell"])
    return filled.select("event_id", C.to_number(F.col("cell")).alias("value"))


# ---------------------------------------------------------------- gaps


def _out(df, *extra):
    return rounded(df.select("row_id", *extra, *SENSORS), *SENSORS)


def _fw(c):
    return f'last_value("{c}" IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING)'


def _bw(c):
    return f'first_value("{c}" IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)'


def _each(template):
    return ", ".join(f'round({template(c)}, 6) AS "{c}"' for c in SENSORS)


@query(
    "n1_chunk_mean_fill",
    f"""WITH {SENSOR_WIDE}, c AS (SELECT *, row_id // 1000 AS chunk FROM wide)
    SELECT row_id, {_each(lambda c: f'coalesce("{c}", avg("{c}") OVER (PARTITION BY chunk))')} FROM c""",
)
def n1_chunk_mean_fill(spark, sf_dir):
    """Gaps take the mean of their chunk (here 1,000 rows)."""
    return _out(impute.chunk_mean_fill(sensor_wide(spark, sf_dir), SENSORS, rows=1000))


@query("n2_forward_fill", f"WITH {SENSOR_WIDE} SELECT row_id, {_each(_fw)} FROM wide")
def n2_forward_fill(spark, sf_dir):
    return _out(impute.ordered_fill(sensor_wide(spark, sf_dir), SENSORS, backward=False))


@query("n3_backward_fill", f"WITH {SENSOR_WIDE} SELECT row_id, {_each(_bw)} FROM wide")
def n3_backward_fill(spark, sf_dir):
    return _out(impute.ordered_fill(sensor_wide(spark, sf_dir), SENSORS, forward=False))


@query(
    "n4_fill_chain",
    f"WITH {SENSOR_WIDE} SELECT row_id, {_each(lambda c: f'coalesce({_fw(c)}, {_bw(c)}, 0.0)')} FROM wide",
)
def n4_fill_chain(spark, sf_dir):
    """Forward, backward, then 0."""
    return _out(impute.fill_constant(impute.ordered_fill(sensor_wide(spark, sf_dir), SENSORS), SENSORS))


@query(
    "n2_forward_fill_by_entity",
    f"""WITH {READINGS}, g AS (SELECT event_id, user_id, sec, CASE WHEN event_type = 'view' THEN value END AS level FROM ev)
    SELECT event_id, user_id, round(last_value(level IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING), 6) AS level FROM g""",
)
def n2_forward_fill_by_entity(spark, sf_dir):
    """Forward fill inside each entity."""
    e = readings(spark, sf_dir).select(
        "event_id", "user_id", "sec", F.when(F.col("event_type") == "view", F.col("value")).alias("level")
    )
    ordered = with_row_id(e, ["user_id", "sec", "event_id"])
    filled = impute.ordered_fill(ordered, ["level"], entity=["user_id"], backward=False)
    return rounded(filled.select("event_id", "user_id", "level"), "level")


_SPLIT_F = "l_linestatus = 'F'"


@query(
    "n5_min_max_scale",
    f"""WITH {LINE_ITEMS}, p AS (SELECT {", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in MEASURES)}
        FROM lineitem WHERE {_SPLIT_F})
    SELECT row_key, {", ".join(f"round(({c} - a_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END, 6) AS {c}" for c in MEASURES)}
    FROM lk, p""",
)
def n5_min_max_scale(spark, sf_dir):
    """Fitted on the train side, applied to both, not clipped."""
    li = line_items(spark, sf_dir).select("row_key", "l_linestatus", *MEASURES)
    params = scale.params_dict(scale.fit_params(li.filter(_SPLIT_F), MEASURES))
    return rounded(scale.apply_params(li, params).select("row_key", *MEASURES), *MEASURES)


def _wide_split(spark, sf_dir):
    """Sensor minutes cut in time: first two thirds of the rows train."""
    df = stage(impute.fill_constant(impute.ordered_fill(sensor_wide(spark, sf_dir), SENSORS), SENSORS), "filled")
    n = df.count()
    return df.filter(F.col("row_id") < n * 2 // 3), df.filter(F.col("row_id") >= n * 2 // 3)


_FILLED = (
    SENSOR_WIDE
    + f""",
fl AS (SELECT row_id, minute, attack, {", ".join(f'coalesce({_fw(c)}, {_bw(c)}, 0.0) AS "{c}"' for c in SENSORS)} FROM wide),
train AS (SELECT * FROM fl WHERE row_id < (SELECT count(*) FROM wide) * 2 // 3),
test AS (SELECT * FROM fl WHERE row_id >= (SELECT count(*) FROM wide) * 2 // 3),
p AS (SELECT {", ".join(f'min("{c}") AS a_{c}, max("{c}") AS b_{c}, avg("{c}") AS m_{c}, stddev_pop("{c}") AS s_{c}' for c in SENSORS)} FROM train)"""
)


def _mm(c):
    return f'(("{c}" - a_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END)'


_SCALED_TEST = _FILLED + f""",
st AS (SELECT row_id, {", ".join(f'{_mm(c)} AS "{c}"' for c in SENSORS)} FROM test, p),
sr AS (SELECT row_id, {", ".join(f'{_mm(c)} AS "{c}"' for c in SENSORS)} FROM train, p)"""


def _scaled(spark, sf_dir):
    train, test = _wide_split(spark, sf_dir)
    params = scale.params_dict(scale.fit_params(train, SENSORS))
    return scale.apply_params(train, params), scale.apply_params(test, params)


@query(
    "n6_out_of_range",
    f"""WITH {_SCALED_TEST}, long AS ({unpivot_sql(SENSORS, "st")})
    SELECT count(*) AS cells, count(*) FILTER (WHERE value < -0.1 OR value > 1.1) AS outside,
           round(100.0 * count(*) FILTER (WHERE value < -0.1 OR value > 1.1) / count(*), 6) AS pct_outside FROM long""",
)
def n6_out_of_range(spark, sf_dir):
    return rounded(scale.out_of_range(_scaled(spark, sf_dir)[1], SENSORS), "pct_outside")


@query(
    "n7_bad_cells",
    f"""WITH {SENSOR_WIDE}, q AS (SELECT {", ".join(f'CASE WHEN minute % 50 = 0 THEN NULL ELSE "{c}" / (minute % 10) END AS "{c}", minute % 10 AS m_{c}' for c in SENSORS)} FROM wide)
    """ + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) - count("{c}") - count(*) FILTER (WHERE m_{c} = 0 AND "{c}" = 0) AS nulls,
        count(*) FILTER (WHERE isnan("{c}")) AS nans, count(*) FILTER (WHERE isinf("{c}")) AS infs FROM q""" for c in SENSORS
    ),
)
def n7_bad_cells(spark, sf_dir):
    """NULL, NaN and infinite cells are counted apart. Division by zero gives NULL in Spark SQL, so infinities are cast in."""
    df = sensor_wide(spark, sf_dir, with_id=False)
    infinite = F.lit("Infinity").cast("double")
    step = F.col("minute") % 10
    cells = [
        F.when(F.col("minute") % 50 == 0, None).when((step == 0) & F.col(c).isNotNull(), infinite)
        .otherwise(F.col(c) / F.when(step != 0, step)).alias(c)
        for c in SENSORS
    ]
    return profile.column_stats(df.select(*cells), SENSORS).select("feature", "nulls", "nans", "infs")


@query(
    "n8_train_mean_fill",
    f"""WITH {SENSOR_WIDE}, tr AS (SELECT * FROM wide WHERE row_id < (SELECT count(*) FROM wide) * 2 // 3),
    p AS (SELECT {", ".join(f'avg("{c}") AS m_{c}, quantile_cont("{c}", 0.5) AS q_{c}' for c in SENSORS)} FROM tr)
    SELECT row_id, {", ".join(f'round(coalesce("{c}", m_{c}), 6) AS "{c}", round(coalesce("{c}", q_{c}), 6) AS "{c}_median"' for c in SENSORS)}
    FROM wide, p""",
)
def n8_train_mean_fill(spark, sf_dir):
    """Gaps take the mean, or the median, of the training rows."""
    df = sensor_wide(spark, sf_dir)
    n = df.count()
    train = df.filter(F.col("row_id") < n * 2 // 3)
    means = {r["feature"]: r["mean"] for r in profile.column_stats(train, SENSORS).select("feature", "mean").collect()}
    long = C.to_long(train, SENSORS)
    medians = {r["feature"]: r["quantile"] for r in quantiles(long, "value", [0.5], ["feature"]).collect()}
    params = {c: {"mean": means[c], "median": medians[c]} for c in SENSORS}
    both = df.select("row_id", *SENSORS, *[F.col(c).alias(f"{c}_median") for c in SENSORS])
    filled = impute.fill_from_params(both, params, "mean")
    filled = impute.fill_from_params(filled, {f"{c}_median": params[c] for c in SENSORS}, "median")
    return rounded(filled, *SENSORS, *[f"{c}_median" for c in SENSORS])


def _interp(c):
    last_t = f'last_value(CASE WHEN "{c}" IS NOT NULL THEN minute END IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING)'
    next_t = (
        f'first_value(CASE WHEN "{c}" IS NOT NULL THEN minute END IGNORE NULLS) OVER '
        "(ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )
    return f'coalesce("{c}", {_fw(c)} + ({_bw(c)} - {_fw(c)}) * (minute - {last_t})::DOUBLE / ({next_t} - {last_t}))'


@query(
    "n9_interpolate",
    "WITH " + SENSOR_WIDE + " SELECT row_id, " + ", ".join(f'round({_interp(c)}, 9) AS "{c}"' for c in SENSORS) + " FROM wide",
)
def n9_interpolate(spark, sf_dir):
    """Linear in time between neighbours; edges stay open."""
    done = impute.interpolate(sensor_wide(spark, sf_dir), SENSORS, "minute")
    return rounded(done.select("row_id", *SENSORS), *SENSORS, digits=9)


@query(
    "n10_z_score",
    f"""WITH {LINE_ITEMS}, p AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)} FROM lineitem WHERE {_SPLIT_F})
    SELECT row_key, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in MEASURES)} FROM lk, p""",
)
def n10_z_score(spark, sf_dir):
    """Centred and scaled with training moments."""
    li = line_items(spark, sf_dir).select("row_key", "l_linestatus", *MEASURES)
    params = scale.params_dict(scale.fit_params(li.filter(_SPLIT_F), MEASURES))
    return rounded(scale.apply_params(li, params, scale.z_score).select("row_key", *MEASURES), *MEASURES)


_MARKS = "[" + ", ".join(f"{i / 100}" for i in range(101)) + "]"


def _uniform_of(c, digits=6):
    """Interpolation on the 101 training quantiles `q_<c>` from below and from above, averaged."""
    up, down = f"len([x for x in q_{c} if x <= {c}])", f"len([x for x in q_{c} if x < {c}]) + 1"
    mean = f"""((CASE WHEN u_{c} = 0 THEN 0.0 WHEN u_{c} = 101 THEN 1.0
            ELSE (u_{c} - 1 + ({c} - q_{c}[u_{c}]) / (q_{c}[u_{c} + 1] - q_{c}[u_{c}])) / 100.0 END)
          + (CASE WHEN w_{c} = 102 THEN 1.0 WHEN w_{c} = 1 THEN 0.0
            ELSE (w_{c} - 1 - (q_{c}[w_{c}] - {c}) / (q_{c}[w_{c}] - q_{c}[w_{c} - 1])) / 100.0 END)) / 2.0"""
    return f"{up} AS u_{c}, {down} AS w_{c}", f"{mean if digits is None else f'round({mean}, {digits})'} AS {c}"


@query(
    "n11_quantile_uniform",
    f"""WITH {LINE_ITEMS}, p AS (SELECT {", ".join(f"quantile_cont({c}, {_MARKS}) AS q_{c}" for c in MEASURES)} FROM lineitem WHERE {_SPLIT_F}),
    i AS (SELECT *, {", ".join(_uniform_of(c)[0] for c in MEASURES)} FROM lk, p)
    SELECT row_key, {", ".join(_uniform_of(c)[1] for c in MEASURES)} FROM i""",
)
def n11_quantile_uniform(spark, sf_dir):
    """Training quantiles to U(0,1)."""
    li = line_items(spark, sf_dir).select("row_key", "l_linestatus", *MEASURES)
    fitted = scale.fit_quantiles(li.filter(_SPLIT_F), MEASURES, 101)
    return rounded(scale.quantile_transform(li, fitted).select("row_key", *MEASURES), *MEASURES)


def _normal_of(c):
    def horner(part, x):
        out = f"{part[0]!r}::DOUBLE"
        for k in part[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    def fraction(parts, x):
        return f"({horner(parts[0], x)} / {horner(parts[1], x)})"

    low = f"greatest(least({c}, 1.0::DOUBLE - {c}), {scale.NORMAL_CLIP!r}::DOUBLE)"
    q, tail = f"({c} - 0.5::DOUBLE)", fraction(scale.NORMAL_TAIL, f"sqrt(-2.0::DOUBLE * ln({low}))")
    return f"""round(CASE WHEN {low} >= {scale.NORMAL_TAIL_BELOW}::DOUBLE THEN {fraction(scale.NORMAL_CENTRE, f"({q} * {q})")} * {q}
        WHEN {q} < 0 THEN {tail} ELSE -{tail} END, 5) AS {c}"""


@query(
    "n11_quantile_normal",
    f"""WITH {LINE_ITEMS}, p AS (SELECT {", ".join(f"quantile_cont({c}, {_MARKS}) AS q_{c}" for c in MEASURES)} FROM lineitem WHERE {_SPLIT_F}),
    i AS (SELECT *, {", ".join(_uniform_of(c)[0] for c in MEASURES)} FROM lk, p),
    u AS (SELECT row_key, {", ".join(_uniform_of(c, digits=None)[1] for c in MEASURES)} FROM i)
    SELECT row_key, {", ".join(_normal_of(c) for c in MEASURES)} FROM u""",
)
def n11_quantile_normal(spark, sf_dir):
    """Training quantiles to N(0,1)."""
    li = line_items(spark, sf_dir).select("row_key", "l_linestatus", *MEASURES)
    fitted = scale.fit_quantiles(li.filter(_SPLIT_F), MEASURES, 101)
    return rounded(scale.quantile_transform(li, fitted, normal=True).select("row_key", *MEASURES), *MEASURES, digits=5)


def _noise_sql(c):
    u1, u2 = uniform_sql(f"42:a:{c}", "row_key"), uniform_sql(f"42:b:{c}", "row_key")
    return f"round({c} + 0.01 * (sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2})), 6) AS {c}"


@query("n12_gaussian_noise", f"WITH {LINE_ITEMS} SELECT row_key, {_noise_sql('l_quantity')}, {_noise_sql('l_discount')} FROM lk")
def n12_gaussian_noise(spark, sf_dir):
    """Seeded noise on two features."""
    li = line_items(spark, sf_dir).select("row_key", "l_quantity", "l_discount")
    return rounded(scale.add_noise(li, ["l_quantity", "l_discount"], ["row_key"]), "l_quantity", "l_discount")


# ---------------------------------------------------------------- statistics


@query(
    "g1_class_counts",
    """SELECT l_returnflag AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM lineitem GROUP BY 1""",
)
def g1_class_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"))
    return rounded(profile.class_counts(li), "pct")


@query(
    "g2_null_cells",
    f"""WITH {SENSOR_WIDE} SELECT ({" + ".join(f'count(*) - count("{c}")' for c in SENSORS)})::BIGINT AS null_cells FROM wide""",
)
def g2_null_cells(spark, sf_dir):
    return profile.null_cells(sensor_wide(spark, sf_dir, with_id=False), SENSORS)


_VARIANCES = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v FROM lineitem WHERE {_SPLIT_F}" for c in MEASURES)


@query(
    "g3_variance_summary",
    f"""WITH s AS ({_VARIANCES}) SELECT round(min(v), 9) AS min_var, round(max(v), 1) AS max_var, round(median(v), 6) AS median_var FROM s""",
)
def g3_variance_summary(spark, sf_dir):
    """Smallest, largest and median sample variance of the training columns."""
    train = table(spark, sf_dir, "lineitem").filter(_SPLIT_F)
    found = profile.variance_summary(profile.column_stats(train, MEASURES))
    return rounded(rounded(rounded(found, "min_var", digits=9), "max_var", digits=1), "median_var")


@query(
    "g4_low_variance",
    f"""WITH s AS ({_VARIANCES}) SELECT feature, CASE WHEN v < 0.001 THEN 1 ELSE 0 END AS dropped, round(v, CASE WHEN v > 1000 THEN 1 ELSE 9 END) AS variance FROM s""",
)
def g4_low_variance(spark, sf_dir):
    """Columns below the variance threshold, strictly."""
    train = table(spark, sf_dir, "lineitem").filter(_SPLIT_F)
    stats = profile.column_stats(train, MEASURES)
    low = profile.low_variance_columns(stats)
    v = F.col("var_samp")
    return stats.select("feature", F.col("feature").isin(low).cast("int").alias("dropped"), F.when(v > 1000, F.round(v, 1)).otherwise(F.round(v, 9)).alias("variance"))


@query(
    "g5_matrix_stats",
    f"""WITH {_SCALED_TEST}, long AS ({unpivot_sql(SENSORS, "st")})
    SELECT count(value) AS cells, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
           round(min(value), 6) AS min, round(max(value), 6) AS max FROM long""",
)
def g5_matrix_stats(spark, sf_dir):
    """Mean, population deviation and range over all scaled cells."""
    _, test = _scaled(spark, sf_dir)
    return rounded(profile.matrix_stats(profile.column_stats(test, SENSORS)), "mean", "std", "min", "max")


@query("g6_distinct_labels", "SELECT DISTINCT l_returnflag AS label FROM lineitem")
def g6_distinct_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")).distinct()


@query(
    "g7_shapes",
    f"""WITH {SENSOR_WIDE} SELECT 'events' AS stage, count(*) AS n_rows, 6 AS n_columns FROM events
    UNION ALL SELECT 'wide', count(*), 7 FROM sw UNION ALL SELECT 'normal', count(*), 7 FROM sw WHERE attack = 0""",
)
def g7_shapes(spark, sf_dir):
    """Rows and columns after each stage."""
    wide = sensor_wide(spark, sf_dir, with_id=False)
    out = profile.shape(table(spark, sf_dir, "events"), "events")
    return out.unionByName(profile.shape(wide, "wide")).unionByName(profile.shape(wide.filter("attack = 0"), "normal"))
