"""Column builders for sequences, CIGAR strings and flags."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of public standards: complements and meanings of the IUPAC letters, and amino acids of
# the standard genetic code for codons in the order TTT, TTC, TTA, TTG, TCT ... GGG.
COMPLEMENT_FROM = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "[TU]", "U": "[TU]", "R": "[AG]", "Y": "[CTU]", "S": "[CG]", "W": "[ATU]", "K": "[GTU]", "M": "[AC]", "B": "[CGTU]", "D": "[AGTU]", "H": "[ACTU]", "V": "[ACG]", "N": "[ACGTU]"}
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = ["".join(c) for c in product("TCAG", repeat=3)]
# Fixed values of public standards: amino acids and start codons of the genetic codes by their public numbers.
CODES = {
    "1": (STANDARD_CODE, "---M------**--*----M---------------M----------------------------"),
    "2": ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", "----------**--------------------MMMM----------**---M------------"),
    "3": ("FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**----------------------MM---------------M------------"),
    "4": ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--MM------**-------M------------MMMM---------------M------------"),
    "5": ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", "---M------**--------------------MMMM---------------M------------"),
    "6": ("FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    "11": (STANDARD_CODE, "---M------**--*----M------------MMMM---------------M------------"),
}
# pKa of the charged groups of proteins.
PKA_POSITIVE = {"H": 6.5, "K": 10.8, "R": 12.5}
PKA_NEGATIVE = {"D": 3.9, "E": 4.1, "C": 8.5, "Y": 10.1}
PKA_N_TERMINUS, PKA_C_TERMINUS = 8.6, 3.6


def genetic_code(number: str) -> list[tuple[str, str, bool, bool]]:
    """(codon, amino acid, is a start, is a stop) of a genetic code by its public number."""
    acids, starts = CODES[str(number)]
    return [(c, a, s == "M", a == "*") for c, a, s in zip(CODONS, acids, starts, strict=True)]


def count_of(sequence: Column, letters: str) -> Column:
    """How many letters of a set the sequence has."""
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def reverse_complement(sequence: Column) -> Column:
    """The IUPAC reverse complement; other letters stay, case is kept."""
    return F.reverse(F.translate(sequence, COMPLEMENT_FROM, COMPLEMENT_TO))


def clean_letters(sequence: Column, letters: str) -> Column:
    """Struct of the upper-cased sequence without white space and other letters (``sequence``), and how many others it lost (``removed``)."""
    s = F.upper(F.regexp_replace(sequence, r"\s+", ""))
    return F.struct(F.regexp_replace(s, f"[^{letters}]", "").alias("sequence"), F.length(F.translate(s, letters, "")).alias("removed"))


def gc_percent(sequence: Column) -> Column:
    """Percent of G and C among A, C, G, T and U; null without any."""
    known = count_of(sequence, "ACGTUacgtu")
    return count_of(sequence, "GCgc") * 100 / F.when(known > 0, known)


def codons(sequence: Column, frame: int = 0) -> Column:
    """The upper-case DNA codons of a frame; an incomplete last one is left out."""
    s = F.translate(F.upper(sequence), "U", "T")
    return F.regexp_extract_all(F.substring(s, frame + 1, 1 << 30) if frame else s, F.lit("(?s).{3}"), F.lit(0))


def translate(sequence: Column, frame: int = 0, code: str = STANDARD_CODE) -> Column:
    """The protein of a frame; codons with other letters give X."""
    table = F.create_map(*(F.lit(x) for pair in zip(CODONS, code, strict=True) for x in pair))
    return F.array_join(F.transform(codons(sequence, frame), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def melting_temperature(sequence: Column) -> Column:
    """Wallace's rule under 14 letters, else 64.9 + 41 (GC - 16.4) / n."""
    s = F.upper(sequence)
    gc, at, n = count_of(s, "GC"), count_of(s, "ATU"), F.length(sequence)
    return F.when(n == 0, None).when(n < 14, 2.0 * at + 4.0 * gc).otherwise(64.9 + 41.0 * (gc - 16.4) / n)


def iupac_regex(motif: str) -> str:
    """A regular expression for an IUPAC motif."""
    return "".join(IUPAC[c] for c in motif.upper())


def windows(sequence: Column, size: int, step: int) -> Column:
    """Array of (start, text) of the windows of a sequence; a shorter sequence has none. One pass over the letters."""
    texts = F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))
    return F.transform(texts, lambda t, i: F.struct((i * step + 1).alias("start"), t.alias("text")))


def wrapped(sequence: Column, width: int = 60) -> Column:
    """The sequence in lines of ``width`` letters."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def cigar_ops(cigar: Column) -> Column:
    """Array of (size, op); ``*`` and null have none."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_replace(p, "[^0-9]", "").try_cast("long").alias("size"), F.right(p, F.lit(1)).alias("op")))


def _cigar_sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["op"].isin(*ops), p["size"]).otherwise(F.lit(0).cast("long")))


def reference_span(cigar: Column) -> Column:
    """Reference positions an alignment spans (M, D, N, =, X)."""
    return _cigar_sum(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Read letters an alignment uses (M, I, S, =, X)."""
    return _cigar_sum(cigar, "MIS=X")


def covered_blocks(start: Column, cigar: Column) -> Column:
    """Array of (start, end) of the reference blocks under M, = and X."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    state = F.aggregate(
        cigar_ops(cigar),
        F.struct(start.cast("long").alias("pos"), empty.alias("blocks")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.when(p["op"].isin(*"MDN=X"), p["size"]).otherwise(F.lit(0).cast("long"))).alias("pos"),
            F.when(p["op"].isin(*"M=X") & (p["size"] > 0), F.concat(acc["blocks"], F.array(F.struct(acc["pos"].alias("start"), (acc["pos"] + p["size"] - 1).alias("end"))))).otherwise(acc["blocks"]).alias("blocks"),
        ),
    )
    return state["blocks"]


# Fixed values of the SAM format: bits of FLAG.
FLAGS = {1: "paired", 2: "proper_pair", 4: "unmapped", 8: "mate_unmapped", 16: "reverse", 32: "mate_reverse", 64: "first_in_pair", 128: "second_in_pair", 256: "secondary", 512: "qc_fail", 1024: "duplicate", 2048: "supplementary"}


def flag_names(flag: Column) -> Column:
    """The names of the bits that are set."""
    return F.filter(F.array(*(F.when(flag.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in FLAGS.items())), lambda x: x.isNotNull())


def pair_status(flag: Column) -> Column:
    """single, unmapped, mate_unmapped, proper or improper."""
    has = lambda bit: flag.bitwiseAND(F.lit(bit)) != 0
    return F.when(has(4), "unmapped").when(~has(1), "single").when(has(8), "mate_unmapped").when(has(2), "proper").otherwise("improper")


def mate_key(name: Column) -> Column:
    """A read name without its mate suffix (/1, /2, _R1, _R2, .1, .2)."""
    return F.regexp_replace(F.trim(name), r"([/._][12]|_R[12])$", "")


def variant_kind(ref: Column, alt: Column) -> Column:
    """snv, mnv, insertion, deletion, indel, multiallelic or symbolic."""
    r, a = F.length(ref), F.length(alt)
    return (
        F.when(F.contains(alt, F.lit(",")), "multiallelic")
        .when(alt.rlike(r"^[<*.]|[\[\]]"), "symbolic")
        .when((r == 1) & (a == 1), "snv")
        .when(r == a, "mnv")
        .when((r < a) & F.startswith(alt, ref), "insertion")
        .when((r > a) & F.startswith(ref, alt), "deletion")
        .otherwise("indel")
    )


# Monoisotopic-free average residue masses (Da) and Kyte-Doolittle hydropathies of the amino acids.
RESIDUE_MASS = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.176, "V": 99.1326}
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}


def protein_mass(sequence: Column) -> Column:
    """Average mass of the known residues plus one water."""
    s = F.upper(sequence)
    total = sum((count_of(s, aa) * F.lit(mass) for aa, mass in RESIDUE_MASS.items()), F.lit(18.015))
    return F.when(F.length(s) > 0, total)


def mean_hydropathy(sequence: Column) -> Column:
    """Mean hydropathy of the known residues."""
    s = F.upper(sequence)
    known = sum((count_of(s, aa) for aa in HYDROPATHY), F.lit(0))
    return sum((count_of(s, aa) * F.lit(h) for aa, h in HYDROPATHY.items()), F.lit(0.0)) / F.when(known > 0, known)


def in_context(sequence: Column, start: Column, end: Column, flank: int = 10) -> Column:
    """The letters ``start`` to ``end`` in upper case between up to ``flank`` neighbours on each side in lower case."""
    a, b = start.cast("int"), end.cast("int")
    first = F.greatest(a - flank, F.lit(1))
    part = lambda i, n: F.substring(sequence, i, n)
    return F.concat(F.lower(part(first, a - first)), F.upper(part(a, b - a + 1)), F.lower(part(b + 1, F.lit(flank))))


def protein_charge(sequence: Column, ph: Column) -> Column:
    """Net charge of a protein at a pH, termini included, by the pKa of its groups."""
    s = F.upper(sequence)
    up = lambda pka: 1 / (1 + F.pow(F.lit(10.0), ph - pka))
    down = lambda pka: 1 / (1 + F.pow(F.lit(10.0), pka - ph))
    positive = sum((count_of(s, aa) * up(pka) for aa, pka in PKA_POSITIVE.items()), up(PKA_N_TERMINUS))
    negative = sum((count_of(s, aa) * down(pka) for aa, pka in PKA_NEGATIVE.items()), down(PKA_C_TERMINUS))
    return positive - negative


def isoelectric_point(sequence: Column, rounds: int = 80) -> Column:
    """The pH at which a protein has no charge, by halving 0 to 14; null without a standard residue."""
    # the seven counts are taken once and go through the rounds
    s = F.upper(sequence)
    groups = {**PKA_POSITIVE, **PKA_NEGATIVE}
    counts = F.struct(*(count_of(s, aa).cast("double").alias(aa) for aa in groups))

    def charge(c: Column, ph: Column) -> Column:
        up = lambda pka: 1 / (1 + F.pow(F.lit(10.0), ph - pka))
        down = lambda pka: 1 / (1 + F.pow(F.lit(10.0), pka - ph))
        return sum((c[aa] * up(p) for aa, p in PKA_POSITIVE.items()), up(PKA_N_TERMINUS)) - sum((c[aa] * down(p) for aa, p in PKA_NEGATIVE.items()), down(PKA_C_TERMINUS))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        more = charge(state["c"], middle) > 0
        return F.struct(F.when(more, middle).otherwise(state["low"]).alias("low"), F.when(more, state["high"]).otherwise(middle).alias("high"), state["c"].alias("c"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), counts.alias("c"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)
    return F.when(count_of(s, "".join(RESIDUE_MASS)) > 0, (end["low"] + end["high"]) / 2)


def grouped(sequence: Column, size: int = 10, per_line: int = 6) -> Column:
    """The sequence in groups of ``size`` letters, ``per_line`` of them in a line."""
    spaced = lambda line: F.regexp_replace(line, f"(.{{{size}}})(?=.)", "$1 ")
    lines = F.regexp_extract_all(sequence, F.lit(f"(?s).{{1,{size * per_line}}}"), F.lit(0))
    return F.array_join(F.transform(lines, spaced), "\n")


def auto_window(length: Column) -> Column:
    """A window size for a sequence of that length: an eighth, at least 6, up to 120 letters; 25 up to 1,000; then the next of 1, 2 or 5 times a power of ten that makes 1,200 windows at most."""
    rough = F.greatest(F.lit(1.0), F.ceil(length / F.lit(1200.0)).cast("double"))
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    scaled = rough / power
    nice = F.when(scaled <= 1, power).when(scaled <= 2, 2 * power).when(scaled <= 5, 5 * power).otherwise(10 * power)
    long_ = F.greatest(F.lit(25.0), F.least(length.cast("double"), nice))
    return F.when(length <= 0, 1).when(length <= 120, F.greatest(F.lit(6), F.ceil(length / F.lit(8.0)).cast("int"))).when(length <= 1000, 25).otherwise(long_.cast("int"))


def codon_alignment(protein: Column, coding: Column) -> Column:
    """A coding sequence spaced as its aligned protein: three gaps for each gap, else the next codon (gaps where the codons end)."""
    letters = F.regexp_extract_all(protein, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, letter: Column) -> Column:
        codon = F.substring(coding, state["at"] * 3 + 1, F.lit(3))
        gap = letter == "-"
        return F.struct((state["at"] + F.when(gap, 0).otherwise(1)).alias("at"), F.concat(state["out"], F.array(F.when(gap | (F.length(codon) < 3), "---").otherwise(codon))).alias("out"))

    return F.array_join(F.aggregate(letters, start, step)["out"], "")


def aligned_bases(start: Column, cigar: Column, sequence: Column) -> Column:
    """Array of (position, base) of the read letters under M, = and X; without a CIGAR all letters in a row from ``start``. A letter that the read lacks is N."""
    plain = F.transform(F.regexp_extract_all(F.upper(sequence), F.lit("."), F.lit(0)), lambda b, i: F.struct((start + i).cast("long").alias("position"), b.alias("base")))
    empty = F.array().cast("array<struct<position:bigint,base:string>>")
    zero = F.lit(0).cast("long")

    def step(state: Column, op: Column) -> Column:
        run, both, read, ref = op["size"], op["op"].isin("M", "=", "X"), op["op"].isin("I", "S"), op["op"].isin("D", "N")
        each = F.transform(F.sequence(zero, run - 1), lambda i: F.struct((state["pos"] + i).alias("position"), F.coalesce(F.nullif(F.substring(F.upper(sequence), (state["at"] + i + 1).cast("int"), F.lit(1)), F.lit("")), F.lit("N")).alias("base")))
        return F.struct(
            (state["pos"] + F.when(both | ref, run).otherwise(zero)).alias("pos"),
            (state["at"] + F.when(both | read, run).otherwise(zero)).alias("at"),
            F.when(both & (run > 0), F.concat(state["out"], each)).otherwise(state["out"]).alias("out"),
        )

    first = F.struct(start.cast("long").alias("pos"), zero.alias("at"), empty.alias("out"))
    return F.when(F.coalesce(cigar, F.lit("*")).isin("*", ""), plain).otherwise(F.aggregate(cigar_ops(cigar), first, step)["out"])
