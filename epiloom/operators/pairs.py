"""Receptor x panel pairs for a scorer, and its scores taken back under audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hla
from ..functions.genes import resolution_status
from ..functions.text import AA20, InputError, clean, pair_id, usable_cdr3
from .ranking import finite

#: Panels up to this many rows are sent to every task of a product; larger ones meet the receptors part by part.
SENT_PANEL = 100_000
COMPONENTS = ["cdr3a", "trav", "traj", "cdr3b", "trbv", "trbj"]
IDENTITY = ["receptor_id", *COMPONENTS, "peptide", "hla"]


def normalized_panel(panel: DataFrame, species: str | None = None) -> DataFrame:
    """Distinct upper-case peptides with canonical molecules; hla_error where a name can't be read or is of another species, hla_abstains where a model isn't given it."""
    panel = panel if "hla" in panel.columns else panel.withColumn("hla", F.lit(None).cast("string"))
    p = panel.select(F.upper(clean("peptide")).alias("peptide"), clean("hla").alias("_hla"))
    if p.filter(~F.coalesce(F.col("peptide").rlike(rf"\A[{AA20}]+\z"), F.lit(False))).limit(1).count():
        raise InputError("a peptide has letters beyond the twenty residues")
    named = hla.normalized(p.distinct(), "_hla", "hla", species)
    return named.select("peptide", "hla", "hla_error", "hla_abstains").distinct()


def component_problem() -> Column:
    """Why a receptor can't be given to a scorer, or empty: both chains, one plain call for each gene.

    A slash belongs to one gene only where an alpha V gene serves in delta as well; paralogs have a D after either number.
    """
    dual = r"[0-9]+D?(-[0-9]+)?/DV[0-9]+D?(-[0-9]+)?"
    number = lambda prefix: rf"({dual}|[0-9]+[0-9A-Z-]*)" if prefix == "TRAV" else "[0-9]+[0-9A-Z-]*"
    call = lambda c, prefix: F.coalesce(F.col(c).rlike(rf"\A{prefix}{number(prefix)}(\*[0-9]+)?\z"), F.lit(False))
    return F.concat_ws(
        "; ", F.when(~F.col("pairing_status").isin("paired", "single_pair"), F.concat(F.lit("pairing is "), F.col("pairing_status"))), F.when(~usable_cdr3("cdr3a"), "no usable alpha junction"),
        F.when(~usable_cdr3("cdr3b"), "no usable beta junction"), *[F.when(~call(c, c.upper()), f"{c} isn't one {c.upper()} call") for c in ("trav", "traj", "trbv", "trbj")],
    )


def export_pairs(receptors: DataFrame, panel: DataFrame, donors: DataFrame | None = None, max_pairs: int | None = 1_000_000, species: str = "human") -> DataFrame:
    """Every receptor with every distinct panel row: pair_id, the identity columns, and skip_reason (null: to be scored).

    Molecules that aren't one expressed protein, named to two fields and with both
    chains where there are two, are no model's input: they are skipped with the rule's reason.

    The panel is the stated set; both sides are counted first, and the product
    may not exceed max_pairs.  None: no bound; pairs are made as they are read, so
    that their number costs time and room of the output only.
    """
    wanted = normalized_panel(panel, species)
    m = wanted.count()
    if max_pairs is not None and (n := receptors.count()) * m > max_pairs:
        raise InputError(f"{n} receptors x {m} panel rows exceed {max_pairs} pairs")
    small = wanted.withColumn("_panel_problem", F.when(F.col("hla_error").isNotNull(), F.col("hla_error")).when(F.col("hla").isNull(), "the panel names no molecule").otherwise(F.col("hla_abstains"))).drop("hla_error", "hla_abstains")
    mine = receptors.select("receptor_id", "donor_id", *COMPONENTS, "pairing_status").withColumn("_problem", F.nullif(component_problem(), F.lit("")))
    full = mine.crossJoin(F.broadcast(small) if m <= SENT_PANEL else small)
    typing_problem = F.lit(None).cast("string")
    if donors is not None:
        typing = donors.groupBy("donor_id").agg(F.sort_array(F.collect_set("hla")).alias("_typing"))
        full = hla.donor_compared(full.join(typing, "donor_id", "left"), "hla", "_typing", "_donor", "_donor_reason")
        typing_problem = F.when(F.col("_donor") != "compatible", F.concat(F.lit("donor: "), F.col("_donor_reason")))
    reason = F.coalesce(F.col("_panel_problem"), F.col("_problem"), typing_problem)
    return full.select(pair_id("receptor_id", "hla", "peptide").alias("pair_id"), "receptor_id", "donor_id", *COMPONENTS, "peptide", "hla", reason.alias("skip_reason"))


def numeric_score(c: str) -> Column:
    """A number, or null for missing and the spellings of not a number; other text is told by `bad_score`."""
    text = clean(F.col(c).cast("string"))
    return F.when(~F.lower(text).isin("na", "nan"), text.try_cast("double"))


def bad_score(c: str) -> Column:
    text = clean(F.col(c).cast("string"))
    return F.coalesce(~F.lower(text).isin("na", "nan") & text.try_cast("double").isNull(), F.lit(False))


def import_scores(expected: DataFrame, scores: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Expected pairs with their scores, each ModelHypothesis or Unresolved with a reason.

    Scores of unknown pairs, repeated pairs and changed identities are errors.
    A score that comes with a reason, a failure flag or no finite value is none.
    """
    if scores.join(expected.select("pair_id"), "pair_id", "left_anti").limit(1).count():
        raise InputError("a score belongs to no exported pair")
    if scores.groupBy("pair_id").count().filter("count > 1").limit(1).count():
        raise InputError("a pair is scored twice")
    if scores.filter(bad_score("score")).limit(1).count():
        raise InputError("a score isn't a number")
    same = [c for c in IDENTITY if c in scores.columns]
    told = scores.select("pair_id", numeric_score("score").alias("_score"), *[F.col(c) for c in scores.columns if c in ("ok", "reason", "TRAV", "TRAJ", "TRBV", "TRBJ")], *[F.col(c).alias(f"_x_{c}") for c in same])
    both = expected.join(told, "pair_id", "left")
    if same:
        differs = F.lit(False)
        for c in same:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_x_{c}"))
        if both.join(told.select("pair_id"), "pair_id", "left_semi").filter(differs).limit(1).count():
            raise InputError("a scored pair's components aren't those exported")
    reason = clean("reason") if "reason" in told.columns else F.lit(None).cast("string")
    failed = ~finite("_score") | reason.isNotNull()
    if "ok" in told.columns:
        failed = failed | F.coalesce(~F.col("ok").cast("boolean"), F.lit(False))
    why = F.when(failed, F.coalesce(reason, F.lit("the scorer gave no finite score")))
    out = both.select(*expected.columns, F.when(~failed, F.col("_score")).alias("score"), F.when(failed, "Unresolved").otherwise("ModelHypothesis").alias("status"), why.alias("reason"), *[F.col(g).alias(f"recon_{g.lower()}") for g in ("TRAV", "TRAJ", "TRBV", "TRBJ") if g in told.columns])
    for g in ("trav", "traj", "trbv", "trbj"):
        if f"recon_{g}" in out.columns:
            out = out.withColumn(f"{g}_resolution", resolution_status(g, f"recon_{g}"))
    if mapping is not None:
        marked = mapping.select("receptor_id", *[c for c in mapping.columns if c != "receptor_id"], F.lit("linked").alias("mapping_status"))
        out = out.join(marked, "receptor_id", "left").withColumn("mapping_status", F.coalesce("mapping_status", F.lit("mapping_unavailable")))
    return out


def library_lookup(panel: DataFrame, library: DataFrame) -> DataFrame:
    """panel with status, score, reason of a precomputed library: found, found without a value, or absent."""
    if library.groupBy("peptide", "hla").count().filter("count > 1").limit(1).count():
        raise InputError("the library has a pair twice")
    known = library.select("peptide", "hla", numeric_score("score").alias("_score"), F.lit(True).alias("_there"))
    both = panel.select("peptide", "hla").distinct().join(known, ["peptide", "hla"], "left")
    there = F.coalesce("_there", F.lit(False)) & finite("_score")
    reason = F.when(there, F.lit(None).cast("string")).when(F.col("hla").isNull(), "the panel names no molecule").when(F.col("_there").isNull(), "the pair isn't in the library").otherwise("the library has no finite score of the pair")
    return both.select("peptide", "hla", F.when(there, F.col("_score")).alias("score"), F.when(there, "PrecomputedScore").otherwise("Unresolved").alias("status"), reason.alias("reason"))


def clone_labels(cells: DataFrame, clone: str = "receptor_id", label: str = "label") -> DataFrame:
    """clone, label, n_cells, conflict: how often each clone's cells have each label, and whether labels differ."""
    counts = cells.filter(F.col(label).isNotNull()).groupBy(clone, label).agg(F.count("*").alias("n_cells"))
    kinds = counts.groupBy(clone).agg((F.count("*") > 1).alias("conflict"))
    return counts.join(kinds, clone)


def stable_result(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """The contract's columns, typed, nulls where the frame has none; what else it has follows."""
    typed = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in contract]
    return df.select(*typed, *[c for c in df.columns if c not in {c for c, _ in contract}])
