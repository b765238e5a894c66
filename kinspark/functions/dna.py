"""Allele, name and contig expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Authority rank of a name's letters, lower preferred; 90 and above are provisional.
NAME_RANKS = {"M": 1, "P": 2, "L": 3, "U": 4, "V": 5, "PF": 6, "CTS": 7, "Z": 8, "S": 9, "DF": 10, "FGC": 11, "BY": 12, "FT": 13, "Y": 14, "A": 15, "YFS": 90, "YFE": 91, "FTE": 92}
OTHER_RANK = 50
CHROMOSOMES = [str(n) for n in range(1, 23)] + ["X", "Y"]


def dna_complement(allele: Column) -> Column:
    """Complement base by base; other letters stay."""
    return F.translate(F.upper(allele), "ACGT", "TGCA")


def revcomp(allele: Column) -> Column:
    """Reverse complement of an allele."""
    return F.reverse(dna_complement(allele))


def expand_repeat(allele: Column) -> Column:
    """`3T` becomes `TTT`; nucleotides pass; markers keep their letters; null becomes empty."""
    up = F.upper(F.trim(F.coalesce(allele, F.lit(""))))
    digits, letters = F.regexp_replace(up, "[^0-9]", ""), F.regexp_replace(up, "[0-9]", "")
    counted = F.when((digits != "") & (letters != ""), F.expr("true")).otherwise(F.lit(False))
    return F.when(up.rlike("^[ACGTN]+$"), up).when(counted, F.repeat(letters, F.when(digits == "", 0).otherwise(digits.cast("int")))).otherwise(letters)


def mutation_type(anc: Column, der: Column) -> Column:
    """SNP, MNP (equal lengths) or INDEL."""
    a, d = expand_repeat(anc), expand_repeat(der)
    bases = a.rlike("^[ACGT]+$") & d.rlike("^[ACGT]+$")
    return F.when(bases & (F.length(a) == 1) & (F.length(d) == 1), "SNP").when(bases & (F.length(a) == F.length(d)), "MNP").otherwise("INDEL")


def _common(a: Column, d: Column, most: Column) -> Column:
    """How many leading characters a and d share, up to `most`."""
    places = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    same = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, i: F.struct(
        (acc["n"] + (acc["on"] & (i <= most) & (F.substring(a, i, F.lit(1)) == F.substring(d, i, F.lit(1)))).cast("int")).alias("n"),
        (acc["on"] & (i <= most) & (F.substring(a, i, F.lit(1)) == F.substring(d, i, F.lit(1)))).alias("on")), lambda acc: acc["n"])
    return same


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def allele_canon(anc: Column, der: Column) -> Column:
    """Strand-canonical `anc>der`: an SNP is the lesser of its two strands, an indel loses common ends but a base."""

    def head(x: Column) -> Column:
        n = _common(x["a"], x["d"], F.least(F.length(x["a"]), F.length(x["d"])) - 1)
        return _let(n, lambda k: F.concat(F.substring(x["a"], k + 1, F.length(x["a"])), F.lit(">"), F.substring(x["d"], k + 1, F.length(x["d"]))))

    def trimmed(a: Column, d: Column) -> Column:
        n = _common(F.reverse(a), F.reverse(d), F.least(F.length(a), F.length(d)) - 1)
        cut = _let(n, lambda k: F.struct(F.substring(a, F.lit(1), F.length(a) - k).alias("a"), F.substring(d, F.lit(1), F.length(d) - k).alias("d")))
        return _let(cut, head)

    def canon(x: Column) -> Column:
        a, d = x["a"], x["d"]
        plain = F.concat(a, F.lit(">"), d)
        bases = a.rlike("^[ACGT]+$") & d.rlike("^[ACGT]+$")
        return (
            F.when(bases & (F.length(a) == 1) & (F.length(d) == 1), F.least(plain, F.concat(dna_complement(a), F.lit(">"), dna_complement(d))))
            .when(bases & (F.length(a) != F.length(d)), trimmed(a, d))
            .otherwise(plain)
        )

    return _let(F.struct(expand_repeat(anc).alias("a"), expand_repeat(der).alias("d")), canon)


def name_rank(name: Column) -> Column:
    """Rank of the authority that a name's leading letters tell."""
    ranks = F.create_map(*[F.lit(x) for kv in NAME_RANKS.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.upper(F.regexp_extract(name, "^[A-Za-z]+", 0))), F.lit(OTHER_RANK))


def canonical_contig(raw: Column) -> Column:
    """`chr1`..`chr22`, `chrX`, `chrY`, `chrM` for all spellings; other contigs stay."""
    core = F.upper(F.regexp_replace(F.regexp_replace(raw, "(?i)^chr", ""), "(?i)_hs1$", ""))
    return F.when(core.isin(CHROMOSOMES), F.concat(F.lit("chr"), core)).when(core.isin("M", "MT"), "chrM").otherwise(raw)


def karyotype_order(contig: Column) -> Column:
    """Sort key: 1..22, X, Y, M, then others by name."""
    core = F.upper(F.regexp_replace(contig, "(?i)^chr", ""))
    number = core.try_cast("int")
    rank = F.when(number.between(1, 22), number).when(core == "X", 23).when(core == "Y", 24).when(core.isin("M", "MT"), 25).otherwise(26)
    return F.struct(rank.alias("rank"), F.when(rank == 26, core).otherwise("").alias("rest"))


def is_placeholder_name(name: Column) -> Column:
    return name.isNull() | name.like("chr%:%")


def established_name(aliases: Column) -> Column:
    """First alias that is neither minted (DU and digits) nor a placeholder."""
    return F.get(F.filter(aliases, lambda a: ~a.rlike("^DU[0-9]+$") & ~a.like("chr%:%")), 0)


def naming_status(name: Column, status: Column) -> Column:
    """Under review stays; a real name is NAMED; null and placeholders are UNNAMED."""
    return F.when(status == "PENDING_REVIEW", status).when(is_placeholder_name(name), "UNNAMED").otherwise("NAMED")


def natural_key(name: Column) -> Column:
    """Text whose order is natural order: every run of digits padded to 20 places."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
