"""Night-level and subject-level tables, and the reshapes between wide sheets and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actispark.functions.scalars import REST_QUALITY, SLEEP_QUALITY, seconds_of, with_sleep_ratios
from actispark.operators import clinical
from actispark.operators.nights import diary_metrics, diary_timeline, with_norms

METRICS = ("tib", "sol", "sol_norm", "waso", "waso_norm", "wasf", "tst", "wb", "awk5plus", "awk5plus_norm", "se", "se_norm", "sf")
FLAGS = ("pPD", "pMCI", "HC", "SA")


def _prefixed(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(m).alias(f"{prefix}_{m}") for m in METRICS])


def night_rows(nights: DataFrame, subjects: DataFrame) -> DataFrame:
    """nights with ratios and norms, and the subject's flags."""
    who = subjects.select(F.col("code").alias("subject"), "age", *FLAGS)
    return with_norms(with_sleep_ratios(nights).join(who, "subject"))


def diary_dataset(diary: DataFrame, intervals: DataFrame, subjects: DataFrame) -> DataFrame:
    """A row per diary day: subject, date, flags, metrics."""
    rows = diary_metrics(diary, intervals, subjects).join(subjects.select(F.col("code").alias("subject"), *FLAGS), "subject")
    return rows.select("subject", "date", *FLAGS, *METRICS)


def night_dataset(nights: DataFrame, diary: DataFrame, intervals: DataFrame, subjects: DataFrame) -> DataFrame:
    """A row per night that has a diary day: subject, date, flags, the night's metrics and the diary's (diary_)."""
    days = _prefixed(diary_metrics(diary, intervals, subjects), "diary", "day_id")
    rows = night_rows(nights, subjects)
    dates = diary.select("day_id", F.col("date").alias("_date"))
    return rows.drop("date").join(dates, "day_id").join(days, "day_id").select("night_id", "subject", F.col("_date").alias("date"), *FLAGS, *METRICS, *[f"diary_{m}" for m in METRICS])


def night_activity_dataset(dataset: DataFrame, features: DataFrame) -> DataFrame:
    """dataset with every feature row of its night."""
    return dataset.join(features, "night_id")


def first_features(features: DataFrame, key: str = "night_id", order: str = "day_index") -> DataFrame:
    return features.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") == 1).drop("_r")


def night_algorithmic_dataset(dataset: DataFrame, algorithmic: DataFrame, features: DataFrame) -> DataFrame:
    """dataset with its algorithmic nights and the first feature row of each; those without features are dropped."""
    cols = [c for c in ("sol", "waso", "tst", "wb", "awk5plus", "se", "sf") if c in algorithmic.columns]
    alg = algorithmic.select("algorithmic_id", "night_id", *[F.col(c).alias(f"algorithmic_{c}") for c in cols])
    return dataset.join(alg, "night_id").join(first_features(features, "algorithmic_id"), "algorithmic_id")


def subject_averages(df: DataFrame, key: str = "subject") -> DataFrame:
    """Means of all metrics and norm codes by subject, in the subjects' order."""
    cols = [m for m in METRICS if m in df.columns]
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in cols]).orderBy(key)


def clinic_averages(dataset: DataFrame, key: str = "subject") -> DataFrame:
    """Means of the night's and of the diary's metrics, side by side."""
    return dataset.groupBy(key).agg(*[F.avg(c).alias(f"avg_{c}") for m in METRICS for c in (m, f"diary_{m}")]).orderBy(key)


def overall_norms(df: DataFrame, key: str = "subject") -> DataFrame:
    """The mean norm code of each metric by subject, and the class it rounds to (halves to even)."""
    norms = [m for m in METRICS if m.endswith("_norm") and m in df.columns]
    return df.groupBy(key).agg(*[x for m in norms for x in (F.avg(m).alias(f"avg_{m}"), F.bround(F.avg(m), 0).cast("int").alias(m))])


def night_counts(nights: DataFrame, recordings: DataFrame, full: int = 7) -> DataFrame:
    """subject, nights, complete (whether full): nights of recordings that aren't for training."""
    tests = recordings.where(~F.col("training_data")).select("recording_id")
    return nights.join(tests, "recording_id", "left_semi").groupBy("subject").agg(F.count("*").alias("nights")).withColumn("complete", F.col("nights") == full)


# --- diary sheets -----------------------------------------------------------------------------------------------------

#: The fields of a day in the wide sheet.
FIELDS = ("date", "1a", "1b", "2a", "2b", "3a", "3b", "4", "5", "6", "7", "8", "9", "10", "11", "12")


def diary_from_wide(df: DataFrame, days: int = 7) -> DataFrame:
    """A row per day of wide sheets of texts; days whose date doesn't parse are skipped. Falling asleep is bed time plus
    minutes, getting up is wake time plus minutes, both modulo a day. day goes on from sheet to sheet of a subject, where
    the sheets have numbers."""
    sheet = F.col("sheet").cast("int") * days if "sheet" in df.columns else F.lit(0)
    cell = lambda i, f: F.col(f"`day{i}-{f}`").cast("string")
    wide = F.array(*[F.struct(F.lit(i).alias("day"), *[cell(i, f).alias(f"f{f}") for f in FIELDS]) for i in range(1, days + 1)])
    rows = df.select(F.col("`#personalID`").cast("string").alias("subject"), sheet.alias("_s"), F.inline(wide))
    date = F.coalesce(*[F.try_to_timestamp("fdate", F.lit(p)) for p in ("yyyy-MM-dd", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss")]).cast("date")
    whole = lambda f: F.col(f"f{f}").try_cast("double").cast("int")
    minutes = lambda f: F.coalesce(F.col(f"f{f}").try_cast("double"), F.lit(0.0)) * 60
    later = lambda clock, f: F.pmod(seconds_of(f"f{clock}") + minutes(f), F.lit(86_400)).cast("int")
    code = lambda f, codes: F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.lower(F.trim(f"f{f}")))
    return rows.where(date.isNotNull() & F.col("subject").isNotNull()).select(
        "subject", (F.col("_s") + F.col("day")).alias("day"), date.alias("date"), whole("1a").alias("day_sleep_count"), seconds_of("f1b").alias("day_sleep_time"), whole("2a").alias("alcohol_count"), seconds_of("f2b").alias("alcohol_time"),
        whole("3a").alias("caffeine_count"), seconds_of("f3b").alias("caffeine_time"), F.col("f4").isin("1", "true", "True", "1.0").alias("sleeping_pill"), seconds_of("f5").alias("sleep_time"), later("5", "6").alias("sleep_duration"),
        F.col("f7").alias("wakes"), seconds_of("f8").alias("wake_time"), later("8", "9").alias("get_up_time"), code("10", SLEEP_QUALITY).alias("sleep_quality"), code("11", REST_QUALITY).alias("rest_quality"), F.col("f12").alias("note"),
    )


def wake_count(wakes: str | Column = "wakes") -> Column:
    """The number before the first semicolon."""
    c = F.col(wakes) if isinstance(wakes, str) else wakes
    return F.trim(F.get(F.split(c, ";"), F.lit(0))).try_cast("double").cast("int")


def parse_wake_intervals(df: DataFrame, keys: list[str], wakes: str = "wakes") -> DataFrame:
    """keys, start, end (seconds of day) of 'n; hh:mm-hh:mm; ...': without an end it is the start; of several intervals
    with one start the last counts."""
    parts = df.select(*keys, F.posexplode(F.split(wakes, ";")).alias("i", "part")).where((F.col("i") > 0) & F.col("part").rlike(r"^\s*\d{1,2}:\d{2}"))
    ends = F.split("part", "-")
    start, end = F.trim(F.get(ends, F.lit(0))), F.trim(F.get(ends, F.lit(1)))
    rows = parts.select(*keys, "i", seconds_of(start).alias("start"), seconds_of(F.when(F.coalesce(end, F.lit("")) == "", start).otherwise(end)).alias("end"))
    return rows.groupBy(*keys, "start").agg(F.max_by("end", "i").alias("end"))


def clock(seconds: str | Column) -> Column:
    """Seconds of day as 'HH:mm'."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60 % 60).cast("int"))


def diary_to_wide(diary: DataFrame, intervals: DataFrame, days: int = 7) -> DataFrame:
    """Wide rows of each subject: its days by date, days of them a sheet (day1 to day7), with the string of wakes put together
    again. A subject with more days than a sheet holds has further sheets, numbered 0, 1 ... in sheet."""
    spans = intervals.groupBy("day_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_w"))
    spans = spans.select("day_id", F.array_join(F.transform("_w", lambda w: F.concat(F.lit("; "), clock(w["start"]), F.lit("-"), clock(w["end"]))), "").alias("_wakes"))
    at = diary_timeline(diary).join(spans, "day_id", "left").withColumn("day", F.row_number().over(Window.partitionBy("subject").orderBy("date", "day_id")) - 1)
    at = at.withColumn("sheet", F.floor(F.col("day") / days).cast("int")).withColumn("day", F.col("day") % days + 1)
    text = lambda c: F.col(c).cast("string")
    gap = lambda a, b: (F.pmod(F.timestamp_diff("SECOND", F.col(a), F.col(b)), F.lit(86_400)) / 60).cast("string")
    cells = {
        "date": text("date"), "1a": text("day_sleep_count"), "1b": clock("day_sleep_time"), "2a": text("alcohol_count"), "2b": clock("alcohol_time"), "3a": text("caffeine_count"), "3b": clock("caffeine_time"),
        "4": F.col("sleeping_pill").cast("int").cast("string"), "5": clock("sleep_time"), "6": gap("t1", "t2"), "7": F.concat(text("wake_count"), F.coalesce("_wakes", F.lit(""))), "8": clock("wake_time"), "9": gap("t3", "t4"),
        "10": text("sleep_quality"), "11": text("rest_quality"), "12": F.col("note"),
    }
    long = at.select("subject", "sheet", "day", F.struct(*[c.alias(f) for f, c in cells.items()]).alias("cells"))
    wide = long.groupBy("subject", "sheet").pivot("day", list(range(1, days + 1))).agg(F.first("cells"))
    return wide.select(F.col("subject").alias("#personalID"), "sheet", *[F.col(f"`{i}`")[f].alias(f"day{i}-{f}") for i in range(1, days + 1) for f in FIELDS])


# --- subject matrix ---------------------------------------------------------------------------------------------------


def number_days(df: DataFrame, subject: str = "subject", date: str = "date", row: str = "row") -> DataFrame:
    """df with day_no: 1, 2 ... within a subject by date (null dates last), then by row."""
    w = Window.partitionBy(subject).orderBy(F.col(date).asc_nulls_last(), row)
    return df.where(F.col(subject).isNotNull()).withColumn("day_no", F.row_number().over(w))


def unpivot_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(keys, features, "feature", "value")


def subject_matrix(df: DataFrame, features: list[str], identity: list[str], days: int | None = None, subject: str = "subject", date: str = "date", row: str = "row") -> DataFrame:
    """A row per subject: the first row's identity columns and dayN.feature for every day; days is the greatest number of days
    that a subject may have (else it raises), and is found out if it isn't given."""
    missing = {subject, date, *features, *identity} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    numbered = number_days(df, subject, date, row)
    most = numbered.agg(F.max("day_no")).first()[0] or 1
    if days is not None and most > days:
        raise ValueError(f"a subject has {most} days, more than {days}")
    days = days or most
    first = numbered.where(F.col("day_no") == 1).select(subject, *identity)
    wide = numbered.groupBy(subject).pivot("day_no", list(range(1, days + 1))).agg(F.struct(*[F.first(f).alias(f) for f in features]).alias("v"))
    wide = wide.select(subject, *[F.col(f"`{i}`")[f].alias(f"day{i}.{f}") for i in range(1, days + 1) for f in features])
    return first.join(wide, subject)


def subject_days(df: DataFrame, features: list[str], identity: list[str], subject: str = "subject", date: str = "date", row: str = "row") -> DataFrame:
    """A row per subject and feature: identity of the subject's first row, days (the feature's values in the order of
    number_days, nulls with them), and sd, mad, range, iqr, cv over them. However many days a subject has, the table has the
    same columns; widen_days makes a sheet of it."""
    missing = {subject, date, *features, *identity} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    numbered = number_days(df, subject, date, row).select(F.col(subject).alias("subject"), "day_no", *[F.col(f"`{c}`") for c in identity], *[F.col(f"`{f}`").cast("double").alias(f) for f in features if f not in identity])
    long = numbered.unpivot(["subject", "day_no"], features, "feature", "value")
    days = long.groupBy("subject", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("day_no", "value"))), lambda d: d["value"]).alias("days"))
    stats = clinical.day_statistics(long)
    first = numbered.where(F.col("day_no") == 1).select("subject", *[F.col(f"`{c}`") for c in identity])
    return first.join(days, "subject").join(stats, ["subject", "feature"])


def melted_days(table: DataFrame, identity: list[str]) -> DataFrame:
    """subject, identity, feature, day, value of subject_days."""
    return table.select("subject", *[F.col(f"`{c}`") for c in identity], "feature", F.posexplode("days").alias("day", "value")).withColumn("day", F.col("day") + 1)


def widen_days(table: DataFrame, features: list[str], identity: list[str], days: int) -> DataFrame:
    """The sheet of subject_days for a file: identity, dayN.feature for days days, then SD., MAD., Range., IQR. and CV. of each
    feature. Raises where a subject has more days."""
    most = table.agg(F.max(F.size("days"))).first()[0] or 0
    if most > days:
        raise ValueError(f"a subject has {most} days, more than {days}")
    names = {"SD": "sd", "MAD": "mad", "Range": "range", "IQR": "iqr", "CV": "cv"}
    wide = table.groupBy("subject", *identity).pivot("feature", features).agg(F.first(F.struct("days", *names.values())))
    return wide.select("subject", *[F.col(f"`{c}`") for c in identity], *[F.get(F.col(f"`{f}`")["days"], F.lit(i)).alias(f"day{i + 1}.{f}") for i in range(days) for f in features], *[F.col(f"`{f}`")[k].alias(f"{n}.{f}") for f in sorted(features) for n, k in names.items()])
