"""Column functions: conversions, normalisations, taxonomies, small rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def samples(seconds: Column, fs: Column | float) -> Column:
    """Seconds as samples, cut towards 0."""
    return (seconds * fs).cast("long")


def samples_rounded(seconds: Column, fs: Column | float) -> Column:
    """Seconds as samples, half to even."""
    return F.bround(seconds * fs, 0).cast("long")


def overlap_ratio(width: Column, stride: Column) -> Column:
    return F.when(width > 0, F.greatest(F.lit(0.0), (width - stride) / width)).otherwise(0.0)


def discord_scale(m: Column) -> Column:
    """Brings a z-normalised distance of length m to 0..1."""
    return 1.0 / (2.0 * F.sqrt(m.cast("double")))


def run_id(name: Column) -> Column:
    """``run-`` and at least two digits from a name with [_-]run-(digits) before _, . or its end; else of the name's hash."""
    digits = F.regexp_extract(name, r"[_-]run-(\d+)(?=[_.]|$)", 1)
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    number = F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain)
    return F.concat(F.lit("run-"), F.when(digits != "", number).otherwise(F.lpad(F.lower(F.hex(F.crc32(name) % 65536)), 4, "0")))


def subject_number(name: Column) -> Column:
    digits = F.regexp_extract(name, r"sub-?(\d{3})", 1)
    return F.when(digits != "", digits.cast("int"))


def split_of(subject: Column) -> Column:
    """train for subjects 1 to 96, test for 97 to 125, else null."""
    return F.when(subject.between(1, 96), "train").when(subject.between(97, 125), "test")


# The annotation taxonomy.  Categories by prefix, in the order in which they are tried.
CATEGORIES = {
    "focal_aware": ["sz_foc_a_m", "sz_foc_a_nm", "sz_foc_a_um"],
    "focal_impaired": ["sz_foc_ia_m", "sz_foc_ia_nm", "sz_foc_ia_um"],
    "focal_unknown": ["sz_foc_ua_m", "sz_foc_ua_nm", "sz_foc_ua_um"],
    "focal_bilateral": ["sz_foc_f2b"],
    "generalized_motor": ["sz_gen_m"],
    "generalized_nonmotor": ["sz_gen_nm"],
    "unknown_motor": ["sz_uo_m"],
    "unknown_nonmotor": ["sz_uo_nm"],
    "focal_other": ["sz_foc"],
    "generalized_other": ["sz_gen"],
    "unknown_onset": ["sz_uo"],
    "seizure_unclassified": ["sz"],
}

# Parts of a type's name (lower case) that say motor or non-motor.
MOTOR_PARTS = ["_m_", "_m", "_f2b", "tonic", "clonic", "myoclonic", "atonic", "automatisms", "hyperkinetic", "spasms"]
NONMOTOR_PARTS = ["_nm_", "_nm", "sensory", "cognitive", "emotional", "autonomic", "behavior", "typical", "atypical"]

# The second taxonomy's names by prefix, in order; "sz" alone and names before these have rules of their own.
CATEGORIES_V2 = {
    "Focal Aware": ["sz_foc_a_m", "sz_foc_a_nm", "sz_foc_a_um"],
    "Focal Impaired-Awareness": ["sz_foc_ia_m", "sz_foc_ia_nm", "sz_foc_ia_um"],
    "Focal Unknown-Awareness": ["sz_foc_ua_m", "sz_foc_ua_nm", "sz_foc_ua_um"],
    "Focal to Bilateral TC": ["sz_foc_f2b"],
    "Focal Seizures": ["sz_foc_"],
    "Generalized Seizures": ["sz_gen_m", "sz_gen_nm"],
    "Seizures Unknown Onset": ["sz_uo_m", "sz_uo_nm"],
    "Other Seizures": ["sz"],
}

# Class names and complete type names of the first explicit lists.
CATEGORY_LISTS = {
    "focal_mit_moption": [
        "sz_foc_a_m", "sz_foc_a_m_automatisms", "sz_foc_a_m_atonic", "sz_foc_a_m_clonic", "sz_foc_a_m_spasms", "sz_foc_a_m_hyperkinetic", "sz_foc_a_m_myoclonic", "sz_foc_a_m_tonic",
        "sz_foc_ia_m", "sz_foc_ia_m_automatisms", "sz_foc_ia_m_atonic", "sz_foc_ia_m_clonic", "sz_foc_ia_m_spasms", "sz_foc_ia_m_hyperkinetic", "sz_foc_ia_m_myoclonic", "sz_foc_ia_m_tonic",
        "sz_foc_f2b", "sz_foc_a_um", "sz_foc_ia", "sz_foc_ua_m_hyperkinetic", "sz_foc_ua_m", "sz_foc_ua_m_tonic",
    ],
    "focal_ohne_moption": [
        "sz_foc_a_nm", "sz_foc_ia_nm", "sz_foc_ia_nm_autonomic", "sz_foc_ia_nm_behavior", "sz_foc_ia_nm_cognitive", "sz_foc_ia_nm_emotional", "sz_foc_ia_nm_sensory", "sz_foc_ua_nm",
        "sz_foc_ua_nm_autonomic", "sz_foc_ua_nm_behavior", "sz_foc_ua_nm_cognitive", "sz_foc_ua_nm_emotional", "sz_foc_ua_nm_sensory", "sz_foc_a_nm_behavior", "sz_foc_ia_um",
    ],
    "gen_mit_moption": ["sz_gen_m", "sz_gen_m_tonicClonic", "sz_gen_m_clonic", "sz_gen_m_tonic", "sz_gen_m_myoTC", "sz_gen_m_myoAtonic", "sz_gen_m_atonic", "sz_gen_m_spasms"],
    "gen_ohne_moption": ["sz_gen_nm", "sz_gen_nm_typical", "sz_gen_nm_atypical", "sz_gen_nm_myoclonic", "sz_gen_nm_eyelidMyio"],
    "unknown_mit_moption": ["sz_uo_m", "sz_uo_m_myoclonic", "sz_uo_m_tonicClonic", "sz_uo_m_tonicMyio", "sz_uo_m_hyperkinetic", "sz_uo_m_spasms"],
    "unknown_ohne_moption": ["sz_uo_nm", "sz_uo_nm_behavior"],
}


def _by_prefix(name: Column, table: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    for label, prefixes in reversed(table.items()):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = F.when(hit, label).otherwise(out)
    return out


def category(event_type: Column) -> Column:
    """Category by prefix; unknown for null, empty and ``unknown``, non_seizure for the rest."""
    missing = event_type.isNull() | event_type.isin("", "unknown")
    return F.when(missing, "unknown").otherwise(_by_prefix(event_type, CATEGORIES, "non_seizure"))


def category_v2(event_type: Column) -> Column:
    return (
        F.when(event_type.startswith("bckg") | event_type.startswith("impd"), "Non-Seizure")
        .when(event_type == "sz", "Seizure Unknown Classification")
        .otherwise(_by_prefix(event_type, CATEGORIES_V2, "Unclassified"))
    )


def category_lists(event_type: Column) -> Column:
    """Category by the explicit lists of names."""
    out = F.lit("unclassified")
    for label, names in CATEGORY_LISTS.items():
        out = F.when(event_type.isin(names), label).otherwise(out)
    return out


def motor_class(event_type: Column) -> Column:
    """motor, non-motor, mixed or unknown, by the parts of the name."""
    low = F.lower(event_type)
    motor, non = low.rlike("|".join(MOTOR_PARTS)), low.rlike("|".join(NONMOTOR_PARTS))
    known = event_type.isNotNull() & ~event_type.isin("", "unknown")
    return F.when(known & motor & non, "mixed").when(known & motor, "motor").when(known & non, "non-motor").otherwise("unknown")


# Upper bounds in seconds, left-closed, of the duration buckets.
DURATION_BUCKETS = [(2, "very_short"), (5, "short"), (15, "medium"), (60, "long")]


def duration_bucket(seconds: Column) -> Column:
    out = F.lit("very_long")
    for bound, name in reversed(DURATION_BUCKETS):
        out = F.when(seconds < bound, name).otherwise(out)
    return out


def detection_phase(t: Column, start: Column, end: Column) -> Column:
    """pre, during or post, by where the alarm stands to the interval."""
    return F.when(t < start, "pre").when(t <= end, "during").otherwise("post")


def beats_window(fs: Column | float, bpm: Column | float, beats: Column | float) -> Column:
    """Window length in samples of so many beats, held within 32 to 160 seconds."""
    fs, bpm, beats = (x if isinstance(x, Column) else F.lit(float(x)) for x in (fs, bpm, beats))
    win = F.bround(fs * 60.0 / F.greatest(bpm, F.lit(30.0)) * beats, 0)
    return F.greatest((fs * 32.0).cast("long"), F.least(win.cast("long"), (fs * 160.0).cast("long")))


def latent_window(width: Column | float, rate: Column | float) -> Column:
    """width * rate as an odd number of cells: its floor if odd, else its ceiling if odd, else one more; 1 below 1."""
    n = (width if isinstance(width, Column) else F.lit(float(width))) * rate
    low, high = F.floor(n).cast("long"), F.ceil(n).cast("long")
    return F.when(low == 0, F.lit(1)).when(low % 2 != 0, low).when(high % 2 != 0, high).otherwise(low + 1).cast("long")


def length_range(n: Column, fs: Column) -> Column:
    """Subsequence lengths (low, high, step) for a window of n samples at fs, by the window's duration.

    Under 30 s: from 2 s to 30 % of the window by 1 s; under 300 s: from 5 s to 40 % by 2 s; under 1800 s: from 10 s to half
    of it by 5 s; beyond: from 10 s to 100 s by 10 s.
    """
    big = lambda c: c.cast("long")
    seconds = n / fs
    tier = lambda a, b, c, d: F.when(seconds < 30, a).when(seconds < 300, b).when(seconds < 1800, c).otherwise(d)
    low = tier(F.greatest(big(fs * 2), F.lit(16)), F.greatest(big(fs * 5), F.lit(40)), F.greatest(big(fs * 10), F.lit(8)), big(fs * 10))
    share = tier(F.lit(0.3), F.lit(0.4), F.lit(0.5), F.lit(None))
    high = F.when(seconds < 1800, F.least(F.greatest(big(n * share), low * 2), big(n) - 1)).otherwise(big(fs * 100))
    step = tier(F.greatest(big(fs), F.lit(8)), F.greatest(big(fs * 2), F.lit(16)), F.greatest(big(fs * 5), F.lit(4)), big(fs * 10))
    return F.struct(big(low).alias("low"), big(high).alias("high"), big(step).alias("step"))


def train_split(n: Column, fs: Column | float, minutes: float, share: float) -> Column:
    """Training samples of a window: so many minutes, or a share of the window where that is all of it or more."""
    wanted = (F.lit(minutes * 60.0) * fs).cast("long")
    split = F.when(F.lit(minutes * 60.0) >= n / fs, (n * share).cast("long")).otherwise(F.least(wanted, n - 1))
    return F.greatest(F.lit(1).cast("long"), F.least(split, n.cast("long") - 1))


def clustering_penalty(before: Column, after: Column, events: Column, event_samples: Column, event_share: Column, covered: Column) -> Column:
    """Penalties for clustering too much, from the number of alarms before and after, the true events, their samples and
    share of all samples, and the samples that the clusters cover.

    Fewer clusters than events 4.0 (over five times as many 0.5); a mean span over 10, 5 or 3 times the events' samples
    up to 2.0, 1.5 or 1.0 (events under 1 %, under 5 %, denser); one cluster of over 100 alarms 5.0; a cover of over
    twice the alarms at least 20.0; over 99 % fewer alarms 3.0, over 95 % 1.5.
    """
    reduction = F.when(before > 0, (before - after) / before).otherwise(0.0)
    number = F.when(events > 0, F.when(after < events, 4.0).when(after > events * 5, 0.5).otherwise(0.0)).otherwise(0.0)
    tier = lambda a, b, c: F.when(event_share < 0.01, a).when(event_share < 0.05, b).otherwise(c)
    room = event_samples * tier(10.0, 5.0, 3.0)
    span = F.when(after > 0, covered / after)
    wide = F.when((event_samples > 0) & (event_share > 0) & (span > room), F.least(tier(2.0, 1.5, 1.0), span / F.when(room > 0, room))).otherwise(0.0)
    giant = F.when((after == 1) & (before > 100), 5.0).otherwise(0.0)
    spread = F.when((after > 0) & (covered > before * 2), F.greatest(F.lit(20.0), (covered / F.when(before > 0, before) - 2.0) * 0.1)).otherwise(0.0)
    extreme = F.when(reduction > 0.99, 3.0).when(reduction > 0.95, 1.5).otherwise(0.0)
    return number + wide + giant + spread + extreme


# Safety factor of a length recommendation, by parts of the type's name, in order.
SAFETY = [(["focal", "partial"], 1.5), (["generalized", "gtcs", "tonic"], 2.0), (["absence", "petit"], 1.2), (["myoclonic"], 1.1), (["clonic"], 1.3), (["atonic"], 1.2)]


def length_recommendations(event_type: Column, p5: Column, p25: Column, p75: Column, p95: Column, mean: Column, fs: float) -> Column:
    """Array of (approach, low, high, step) in samples: conservative, focused and aggressive; about 20 steps each."""
    factor = F.lit(1.5)
    for parts, value in reversed(SAFETY):
        factor = F.when(F.lower(event_type).rlike("|".join(parts)), value).otherwise(factor)
    plans = [("conservative", 0.1, p5 * 0.5, 600.0, p95 * factor), ("focused", 0.2, p25 * 0.8, 300.0, p75 * 1.2), ("aggressive", 0.1, mean * 0.5, 200.0, mean * 2.0)]
    out = []
    for name, floor, low, ceiling, high in plans:
        a = F.greatest(F.lit(2).cast("long"), (F.greatest(F.lit(floor), low) * fs).cast("long"))
        b = (F.least(F.lit(ceiling), high) * fs).cast("long")
        out.append(F.struct(F.lit(name).alias("approach"), a.alias("low"), b.alias("high"), F.greatest(F.lit(1).cast("long"), ((b - a) / 20).cast("long")).alias("step")))
    return F.array(*out)
