"""Column functions: motion, sleep norms, ratios, labels, names. Numbers are null, never NaN, where they aren't defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lower limits of the age bands that the norms tell apart.
SCHOOL_AGE, TEENAGER, YOUNG_ADULT, ADULT, OLDER_ADULT = 6, 14, 18, 26, 65


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magnitude(x: str | Column = "x", y: str | Column = "y", z: str | Column = "z") -> Column:
    """Length of the acceleration vector."""
    x, y, z = _col(x), _col(y), _col(z)
    return F.sqrt(x * x + y * y + z * z)


def z_angle(x: str | Column = "x", y: str | Column = "y", z: str | Column = "z") -> Column:
    """Arm angle against the horizontal in degrees; 0 where x and y are 0."""
    x, y, z = _col(x), _col(y), _col(z)
    flat = F.sqrt(x * x + y * y)
    return F.when(flat == 0, F.lit(0.0)).otherwise(F.degrees(F.atan(z / flat)))


def stage_to_sleep(stage: str | Column = "stage") -> Column:
    """1 for the sleep stages R, N1, N2 and N3, else 0."""
    return F.coalesce(_col(stage).isin("R", "N1", "N2", "N3").cast("int"), F.lit(0))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def binarize_scores(df: DataFrame, keys: list[str], score: str = "score", threshold: float = 0.5) -> DataFrame:
    """df with score as 0 or 1: as it is where all of the group's scores are 0 or 1, else by the threshold."""
    binary = F.bool_and(F.col(score).isin(0.0, 1.0)).over(Window.partitionBy(*keys))
    return df.withColumn(score, F.when(F.coalesce(binary, F.lit(True)), F.col(score)).otherwise((F.col(score) >= threshold).cast("double")).cast("int"))


def _bands(value: Column, *pairs: tuple[Column, int]) -> Column:
    out = F.lit(None).cast("int")
    first = True
    for condition, code in pairs:
        out = F.when(condition, code) if first else out.when(condition, code)
        first = False
    return F.when(value.isNull(), F.lit(None).cast("int")).otherwise(out.otherwise(-1))


def norm_sol(age: str | Column, seconds: str | Column, unit_divisor: float = 60.0) -> Column:
    """Sleep latency: 1 appropriate, 0 uncertain, -1 inappropriate for the age."""
    age, v = _col(age), _col(seconds) / unit_divisor
    return _bands(v, ((v >= 0) & (v <= 30), 1), ((v > 30) & (v <= F.when(age >= OLDER_ADULT, 60).otherwise(45)), 0))


def norm_awk5plus(age: str | Column, count: str | Column) -> Column:
    """Awakenings over five minutes."""
    age, v = _col(age), _col(count)
    teen = (age >= TEENAGER) & (age < YOUNG_ADULT)
    return _bands(v, (v < F.when(age >= OLDER_ADULT, 3).otherwise(2), 1), (v < F.when(teen, 3).otherwise(4), 0))


def norm_waso(age: str | Column, value: str | Column, unit_divisor: float = 1.0) -> Column:
    """Wake after sleep onset. The limits read as minutes but are held against the raw value (seconds) unless a divisor is given."""
    age, v = _col(age), _col(value) / unit_divisor
    old, young = age >= OLDER_ADULT, (age < SCHOOL_AGE) | (age >= TEENAGER) & (age < YOUNG_ADULT)
    return _bands(v, (v <= F.when(old, 30).otherwise(20), 1), (old | (v <= F.when(young, 50).otherwise(40)), 0))


def norm_se(age: str | Column, percent: str | Column) -> Column:
    """Sleep efficiency."""
    age, v = _col(age), _col(percent)
    return _bands(v, (v >= 85, 1), (v >= F.when((age >= YOUNG_ADULT) & (age < ADULT), 65).otherwise(75), 0))


def norm_reference(subjects: DataFrame, age: str = "age") -> DataFrame:
    """subjects with, for each metric, the ranges that are appropriate, uncertain and inappropriate at that age."""
    a = F.col(age)
    old, teen, child = a >= OLDER_ADULT, (a >= TEENAGER) & (a < YOUNG_ADULT), a < SCHOOL_AGE
    young = (a >= YOUNG_ADULT) & (a < ADULT)
    pick = lambda *pairs: F.coalesce(*[F.when(c, F.lit(t)) for c, t in pairs[:-1]], F.lit(pairs[-1]))
    rows = [
        ("sol", F.lit("0-30 mins"), pick((old, "31-60 mins"), "31-45 mins"), pick((old, "61+ mins"), "46+ mins")),
        ("awk5plus", pick((old, "0-2"), "0-1"), pick((old, "3"), (teen, "2"), "2-3"), pick((teen, "3+"), "4+")),
        ("waso", pick((old, "0-30 mins"), "0-20 mins"), pick((old, "31+ mins"), (child | teen, "21-50 mins"), "21-40 mins"), pick((old, "-"), (child | teen, "51+ mins"), "41+ mins")),
        ("se", F.lit("100-85%"), pick((young, "84-65%"), "84-75%"), pick((young, "64-0%"), "74-0%")),
    ]
    made = F.array(*[F.struct(F.lit(m).alias("metric"), a1.alias("appropriate"), u.alias("uncertain"), i.alias("inappropriate")) for m, a1, u, i in rows])
    return subjects.select("*", F.inline(made))


def with_sleep_ratios(df: DataFrame, tst_unit: str = "seconds") -> DataFrame:
    """tst = tib - (sol + waso + wasf) where it isn't there, se = 100 tst / tib, sf = wake bouts an hour of sleep."""
    if "tst" not in df.columns:
        df = df.withColumn("tst", F.col("tib") - (F.col("sol") + F.col("waso") + F.col("wasf")))
    if "se" not in df.columns:
        df = df.withColumn("se", 100 * safe_div("tst", "tib"))
    return df.withColumn("sf", safe_div("wb", F.col("tst") / (3600 if tst_unit == "seconds" else 60)))


def psg_timestamps(df: DataFrame, order: str = "row_no") -> DataFrame:
    """df(recording_id, row_no, recording_date, clock 'HH:mm:ss') with ts: from the first row that starts with 00, or from
    a first row between 1 and 11 o'clock, the date is the next day's."""
    w = Window.partitionBy("recording_id").orderBy(order)
    hour = F.try_to_number(F.substring("clock", 1, 2), F.lit("99")).cast("int")
    late = F.substring("clock", 1, 2).eqNullSafe(F.lit("00")) | ((F.row_number().over(w) == 1) & hour.between(1, 11))
    after = F.max(late.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    clock = F.concat_ws(" ", F.date_format(F.date_add("recording_date", after), "yyyy-MM-dd"), F.col("clock"))
    return df.withColumn("ts", F.try_to_timestamp(clock, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def gender_code(col: str | Column) -> Column:
    """F is 1, M is 2, in any case and with blanks around; else null."""
    g = F.upper(F.trim(_col(col).cast("string")))
    return F.when(g == "F", 1).when(g == "M", 2)


def prepare_clinical(df: DataFrame, keep: tuple[str, ...] = ("#Subject", "#Date"), gender: str = "#Gender") -> DataFrame:
    """Gender as a number and all columns but keep as doubles; what is no number is null."""
    of = lambda c: gender_code(F.col(f"`{c}`")).cast("double") if c == gender else F.col(f"`{c}`").try_cast("double")
    return df.select(*[F.col(f"`{c}`") if c in keep else of(c).alias(c) for c in df.columns])


def clean_scored(df: DataFrame, label: str = "SLEEP", score: str = "SLEEP_PREDICTION") -> DataFrame:
    """Rows whose label is 0 or 1 and whose score is a finite number."""
    s = F.col(score)
    return df.where(F.col(label).isin(0, 1) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite values and NaN of cols as null."""
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return df.withColumns({c: fine(c) for c in cols})


def display_feature(col: str | Column) -> Column:
    """'SD.x' as 'x (SD)', for each of the across-day statistics."""
    return F.regexp_replace(_col(col), r"^(SD|MAD|Range|IQR|CV)\.(.*)$", "$2 ($1)")


#: Diagnosis codes and their names.
DIAGNOSES = {0: "HC", 1: "NonHC", 2: "MCI-AD", 3: "preDLB"}


def scenario_label(positive: list[int], negative: list[int]) -> str:
    """The name of a comparison of diagnosis codes."""
    side = lambda codes: "+".join(DIAGNOSES[c] for c in codes)
    return f"scenario-{side(positive)}_vs_{side(negative)}"


def tkeo(df: DataFrame, keys: list[str], order: list[str], col: str, out: str = "tkeo") -> DataFrame:
    """Teager-Kaiser energy x[t]^2 - |x[t+1] x[t-1]|; 0 at a group's first and last row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    energy = F.col(col) * F.col(col) - F.abs(F.lead(col).over(w) * F.lag(col).over(w))
    return df.withColumn(out, F.coalesce(energy, F.lit(0.0)))


def hypnogram(df: DataFrame, flag: str = "sleep", out: str = "state") -> DataFrame:
    return df.withColumn(out, F.when(F.col(flag) == 1, "Sleep").when(F.col(flag) == 0, "Wake"))


#: The RBD questionnaire's answers that count.
RBDSQ = ["q1", "q2", "q3", "q4", "q5", "q61", "q62", "q63", "q64", "q7", "q8", "q9", "q10"]


def rbdsq_scores(df: DataFrame, latest: bool = True) -> DataFrame:
    """Number of true answers of each form; with latest, of each subject's last form only."""
    scored = df.withColumn("score", sum((F.coalesce(F.col(q).cast("int"), F.lit(0)) for q in RBDSQ), F.lit(0)))
    if not latest:
        return scored
    w = Window.partitionBy("subject").orderBy(F.col("creation_date").desc_nulls_last(), F.col("score").desc())
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


#: The diary's answers as numbers, and the clock time that stands for an invalid one.
REST_QUALITY = {"not at all rested": 1, "slightly rested": 2, "somehow rested": 3, "well-rested": 4, "very well-rested": 5}
SLEEP_QUALITY = {"very poor": 1, "poor": 2, "fair": 3, "good": 4, "very good": 5}
INVALID_TIME = 13


def decode_diary(df: DataFrame) -> DataFrame:
    """sleep_quality and rest_quality as 1 to 5 (null for other texts) and age from date_of_birth, where these exist."""
    out = {}
    for c, codes in (("sleep_quality", SLEEP_QUALITY), ("rest_quality", REST_QUALITY)):
        if c in df.columns:
            out[c] = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col(c))
    if "date_of_birth" in df.columns:
        out["age"] = F.year(F.current_date()) - F.year("date_of_birth")
    return df.withColumns(out)


def seconds_of(clock: str | Column) -> Column:
    """'HH:mm[:ss]' as seconds of the day; the stand-in for an invalid time where it is none."""
    c = F.regexp_extract(F.trim(_col(clock)), r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", 0)
    part = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(c, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", i), F.lit("99")).cast("int"), F.lit(0))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(INVALID_TIME)).otherwise(part(1) * 3600 + part(2) * 60 + part(3))
