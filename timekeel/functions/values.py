"""Value rules: missing-time reasons, errors, intervals, names, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import ABSENT_FULL_CLOCKS, FULL_DAY, HALF_DAY, QUANTUM_SEC, col, trimmed

# Fixed values.
WEAK_LINE_WORDS = (
    "cork", "cobh", "midleton", "tralee", "ennis",
    "rosslare", "belfast", "westport", "ballina", "athlone",
)
PASSENGER_TYPES = ("O", "S", "D")
CALLS_AS = {
    "O": "starts here", "S": "stops here", "D": "ends here",
    "T": "passes through", "C": "stops here",
}
EXCLUDED_SERVICE = ("yard", "siding", "spur", "crossover")
LIFECYCLE_TAGS = ("disused", "abandoned", "construction", "razed", "dismantled")
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"


def has_clock(c: Column | str) -> Column:
    """A real clock time is present, by the archive's placeholders."""
    return F.coalesce(~col(c).isin(*ABSENT_FULL_CLOCKS), F.lit(False))


def missing_reason(actual_present: Column, scheduled_present: Column, order: Column | str,
                   furthest: Column | str) -> Column:
    """Why an actual is missing; null when it is there."""
    order, furthest = col(order), col(furthest)
    return (
        F.when(actual_present, F.lit(None).cast("string"))
        .when(~scheduled_present, "structural")
        .when(order > furthest, "future")
        .otherwise("unreported")
    )


def exact_match(actual: Column | str, scheduled: Column | str, comparable: Column) -> Column:
    """Actual equals schedule; null where the two cannot be compared."""
    return F.when(comparable, col(actual) == col(scheduled))


def off_quantum(delay: Column | str) -> Column:
    return F.pmod(col(delay), F.lit(QUANTUM_SEC)) != 0


def nearest_minute(seconds: Column | str) -> Column:
    """Rounded to a whole minute, ties to the even minute."""
    return F.bround(col(seconds) / F.lit(60.0)).cast("bigint") * 60


def rounded_error(q50: Column | str, actual: Column | str) -> Column:
    return nearest_minute(q50) - col(actual)


def inside(actual: Column | str, low: Column | str, high: Column | str) -> Column:
    return col(actual).between(col(low), col(high))


def rival_error(eta: Column | str, arrived: Column | str) -> Column:
    """Rival's minute-precision ETA against the arrival, unwrapped across midnight."""
    eta, arrived = col(eta), col(arrived)
    return eta + F.when(eta < arrived - HALF_DAY, FULL_DAY).otherwise(0) - arrived


def served_low(q10: Column | str, q50: Column | str, offset: Column | str) -> Column:
    return F.least(col(q10) + col(offset), col(q50))


def served_high(q90: Column | str, q50: Column | str, offset: Column | str) -> Column:
    return F.greatest(col(q90) + col(offset), col(q50))


def crosses(q10: Column | str, q50: Column | str, q90: Column | str) -> Column:
    return (col(q10) > col(q50)) | (col(q50) > col(q90))


def rearranged(q10: Column | str, q50: Column | str, q90: Column | str) -> Column:
    """The three quantiles in order, as an array."""
    return F.array_sort(F.array(col(q10), col(q50), col(q90)))


def improvement_pct(ours: Column | str, theirs: Column | str) -> Column:
    ours, theirs = col(ours), col(theirs)
    return F.when(theirs != 0, 100 * (theirs - ours) / theirs)


def weak_line_word(name: Column | str) -> Column:
    """Which keyword flags this name, whole words only; empty when none does."""
    return F.lower(F.regexp_extract(col(name), r"(?i)\b(" + "|".join(WEAK_LINE_WORDS) + r")\b", 1))


def on_weak_line(name: Column | str) -> Column:
    return F.coalesce(weak_line_word(name) != "", F.lit(False))


def placed(lat: Column | str, lon: Column | str) -> Column:
    """A usable position: both parse and they are not the (0, 0) placeholder."""
    la, lo = col(lat).try_cast("double"), col(lon).try_cast("double")
    return F.coalesce((la != 0) | (lo != 0), F.lit(False))


def message_lines(message: Column | str, code: Column | str) -> Column:
    """Message split at its literal `\\n` marks, without a leading code line."""
    raw = F.transform(F.split(col(message), r"\\+n|\n"), lambda x: trimmed(x))
    lines = F.filter(raw, lambda x: x != "")
    leads = F.upper(F.try_element_at(lines, F.lit(1))) == col(code)
    return F.when(leads, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


# Fixed value: how the feed words a report.
REPORT_PATTERN = r"^(Departed|Arrived) (.+?) next stop (.+)$"


def last_report(lines: Column | str) -> Column:
    """The last line as (kind, at, next); null when it does not read as a report."""
    line = F.try_element_at(col(lines), F.lit(-1))
    return F.when(
        line.rlike(REPORT_PATTERN),
        F.struct(
            F.regexp_extract(line, REPORT_PATTERN, 1).alias("kind"),
            F.regexp_extract(line, REPORT_PATTERN, 2).alias("at"),
            F.regexp_extract(line, REPORT_PATTERN, 3).alias("next"),
        ),
    )


def drop_reason(tags: Column | str) -> Column:
    """Why a way is not a running line; null when it is one."""
    tags = col(tags)
    service = F.try_element_at(tags, F.lit("service"))
    out = F.when(service.isin(*EXCLUDED_SERVICE), F.concat(F.lit("service="), service))
    for tag in LIFECYCLE_TAGS:
        out = out.when(
            (F.try_element_at(tags, F.lit(tag)) == "yes")
            | F.map_contains_key(tags, f"{tag}:railway"),
            F.lit(tag),
        )
    return out


def name_key(name: Column | str) -> Column:
    """Case, accents and hyphens removed, spaces collapsed."""
    x = F.translate(F.lower(col(name)), ACCENTED + "-", PLAIN + " ")
    x = F.regexp_replace(x, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tight_name_key(name: Column | str) -> Column:
    """The name key without spaces; two names are equal when these are."""
    return F.replace(name_key(name), F.lit(" "), F.lit(""))


def to_grid(v: Column | str, step: float) -> Column:
    """Rounded to a multiple of `step`, ties to even."""
    return F.bround(col(v) / F.lit(float(step))).cast("bigint") * int(step)
