"""Text, flag and identity expressions (all JVM-side columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AA20 = "ACDEFGHIKLMNPQRSTVWY"
BLANK = " \t\n\v\f\r"


class InputError(ValueError):
    """The input breaks its contract."""


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """Without white space at both ends; empty becomes null."""
    return F.nullif(F.btrim(col(c), F.lit(BLANK)), F.lit(""))


def optional(df, name: str, kind: str = "string") -> Column:
    """The cleaned column, or a null of the given type where the frame has none."""
    return (clean(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def tristate(c: str | Column) -> Column:
    """true, false or unknown; other spellings are told by `bad_flag`."""
    low = F.lower(clean(c))
    return F.when(low.isin("true", "t", "1"), True).when(low.isin("false", "f", "0"), False)


def bad_flag(c: str | Column) -> Column:
    low = F.lower(clean(c))
    return F.coalesce(~low.isin("true", "t", "1", "false", "f", "0"), F.lit(False))


def without_sentinel(c: str | Column) -> Column:
    """The literal None, in any case, means missing."""
    return F.when(F.lower(clean(c)) != "none", clean(c))


def sequence_ambiguous(c: str | Column) -> Column:
    """Letters beyond the twenty amino acids; a missing sequence isn't ambiguous but incomplete."""
    return F.coalesce(~col(c).rlike(rf"\A[{AA20}]+\z"), F.lit(False))


def junction_incomplete(c: str | Column) -> Column:
    """No C ... F/W frame from end to end."""
    return F.coalesce(~col(c).rlike(r"\AC[A-Z*]*[FW]\z"), F.lit(True))


def usable_cdr3(c: str | Column) -> Column:
    """C, at least one of the twenty residues, F or W; unknown is not usable."""
    return F.coalesce(col(c).rlike(rf"\AC[{AA20}]+[FW]\z"), F.lit(False))


def length_prefixed(*parts: str | Column) -> Column:
    """Unambiguous text of a tuple: `<bytes>:<value>` for each part, `-1:` for null."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(col(p)).cast("string"), F.lit(":"), col(p)), F.lit("-1:")) for p in parts])


def digest_id(prefix: str, text: Column, digits: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, digits))


def pair_id(receptor: str | Column, hla: str | Column, peptide: str | Column) -> Column:
    """Identity of a receptor-peptide-MHC pair: the hash of its compact JSON array."""
    return digest_id("pair_", F.to_json(F.array(col(receptor), col(hla), col(peptide))))


def unusable_flags(ambiguous: Column, incomplete: Column, productive: Column, confident: Column, is_cell: Column, observed: Column) -> dict[str, Column]:
    """Why an observed chain cannot be used; unknown quality is no reason."""
    of = lambda c: F.coalesce(c, F.lit(False))
    seen = of(observed)
    return {
        "ambiguous_sequence": seen & of(ambiguous), "incomplete_junction": seen & of(incomplete), "nonproductive": seen & of(~productive),
        "low_confidence": seen & of(~confident), "noncell": seen & of(~is_cell),
    }
