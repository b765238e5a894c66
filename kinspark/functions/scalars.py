"""Small expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def support_bucket(support: Column) -> Column:
    return F.when(support.isNull(), "UNKNOWN").when(support >= 95, "HIGH").when(support >= 70, "MEDIUM").otherwise("LOW")


def low_confidence_call(joint: Column, mono: Column, reverse: Column) -> Column:
    """Not joint-confirmed, or neither of reverse polarity nor monophyletic; missing flags count as confident."""
    return ~F.coalesce(joint, F.lit(True)) | (~F.coalesce(reverse, F.lit(False)) & ~F.coalesce(mono, F.lit(True)))


def conformance(value: Column, norm: Column, spec: Column, band: float = 0.05) -> Column:
    """BELOW, AT or ABOVE the cohort norm, else the spec; null without either or at 0 or less."""
    base = F.coalesce(norm, spec)
    return F.when(base.isNull() | (base <= 0) | value.isNull(), None).when(value < base * (1 - band), "BELOW").when(value > base * (1 + band), "ABOVE").otherwise("AT")


def cm_agree(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(10.0), 0.2 * F.greatest(a, b))


def recency_factor(seconds: Column) -> Column:
    """1 up to 30 days, then linear to 0 at 365; null counts a half."""
    days = seconds / 86400.0
    return F.when(days.isNull(), 0.5).when(days <= 30, 1.0).when(days >= 365, 0.0).otherwise(1 - (days - 30) / 335)


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == "KNOWN", 1.0).when(confidence == "INFERRED", 0.7).otherwise(0.3)


def anchor_sigma(ybp: Column, sigma: Column) -> Column:
    """The stated sigma, else the greater of a tenth of the age and 25 years."""
    return F.coalesce(sigma, F.greatest(F.abs(ybp) * 0.1, F.lit(25.0)))


def wire_float(x: Column) -> Column:
    return x.try_cast("double")


def fmt_file(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"\.cram$"), "CRAM").when(low.rlike(r"\.bam$"), "BAM").when(low.rlike(r"\.(fastq|fq)(\.gz)?$"), "FASTQ").when(low.rlike(r"\.vcf(\.gz)?$"), "VCF").otherwise("OTHER")


def normalize_doi(doi: Column) -> Column:
    return F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def call_tokens(call: Column) -> Column:
    """Candidate names in a published haplogroup call, most specific first; the call as it is isn't among them.

    Steps of a path (`>`) from the last, each without its label (`R-M269` is `M269`), its synonyms
    (`/`) in order and without `*?.,()` around them.  What says that there is no call has none.
    """
    whole = F.trim(call)
    steps = F.reverse(F.split(whole, ">"))
    bare = F.transform(steps, lambda s: F.regexp_replace(F.trim(s), "^[A-Z][A-Za-z0-9]*-", ""))
    tokens = F.transform(F.flatten(F.transform(bare, lambda s: F.split(s, "/"))), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^[*?.,()]+|[*?.,()]+$", "")))
    low = F.lower(whole)
    nothing = low.isin("", "na", "?", "unknown") | low.startswith("n/a")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(tokens, lambda t: (t != "") & (t != whole))))


def has_pii(text: Column) -> Column:
    return F.coalesce(text.contains("@") | (F.length(text) > 200), F.lit(False))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """Shared over the union; 0 for two empty sets."""
    union = a + b - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def normalize_placeholder_contig(name: Column, contig: Column) -> Column:
    """`accession:123A>G` with the coordinate's contig before the colon; other names stay."""
    return F.when(name.rlike("^[^:]+:[0-9]") & contig.isNotNull(), F.concat(contig, F.regexp_extract(name, "^[^:]+(:.*)$", 1))).otherwise(name)


def pick_original_call(entries: Column, primary: str, fallback: str) -> Column:
    """First entry (a map) with a call: its primary key if not blank, else its fallback key."""

    def taken(e: Column) -> Column:
        one, other = F.trim(F.try_element_at(e, F.lit(primary))), F.trim(F.try_element_at(e, F.lit(fallback)))
        return F.coalesce(F.nullif(one, F.lit("")), F.nullif(other, F.lit("")))

    return F.get(F.filter(F.transform(entries, taken), lambda x: x.isNotNull()), 0)


#: Yields, in billions of bases, that a label may state.
TIERS = [15, 30, 45, 60, 90, 120]


def test_profile_label(read_type: Column, read_length: Column, total_bases: Column) -> Column:
    """`WGS150 45Gbases`, `HiFi 90Gbases`: kind, read length of short reads, and the nearest tier of the yield; null without a yield."""
    giga = total_bases / 1e9
    tier = F.array_min(F.array(*[F.struct(F.abs(giga - t).alias("d"), F.lit(t).alias("t")) for t in TIERS]))["t"]
    kind = F.when(read_type == "HIFI", "HiFi").when((read_type == "SHORT") & read_length.isNotNull(), F.concat(F.lit("WGS"), read_length.cast("string")))
    return F.when(total_bases.isNotNull(), F.concat(kind, F.lit(" "), tier.cast("string"), F.lit("Gbases")))


def parse_markers(values: Column) -> Column:
    """Map of marker -> value text to structs (kind, repeats, copies): `13` simple, `11-15` multiCopy, others complex; missing ones (`-`, blank) go."""

    def parsed(k: Column, v: Column) -> Column:
        v = F.trim(v)
        copies = F.when(v.rlike("^[0-9]+(-[0-9]+)+$"), F.transform(F.split(v, "-"), lambda x: x.cast("int")))
        kind = F.when(v.rlike("^[0-9]+$"), "simple").when(copies.isNotNull(), "multiCopy").otherwise("complex")
        return F.struct(kind.alias("kind"), v.try_cast("int").alias("repeats"), copies.alias("copies"))

    return F.transform_values(F.map_filter(values, lambda k, v: v.isNotNull() & ~F.trim(v).isin("-", "")), parsed)
