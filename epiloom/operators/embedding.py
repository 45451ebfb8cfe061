"""Curated references near a receptor's embedding, with what is known of their molecules.

A reference is ruled out before ranking, by the panel or by its own molecule;
what typing rules out never depends on the typing alone, as typing needn't be
complete.  References of one receptor sequence (`identity`) take one place among
the k.  Every place then gives a row for each of its references and each molecule
that the panel names for the peptide.  Nearness is a hypothesis, not a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hla
from ..functions.text import InputError
from ..sources.staging import staged
from .knn import cosine_top_k, halves_balanced, unit_norm

OUTPUT = [
    "receptor_id", "donor_id", "status", "evidence_type", "reference_receptor_id", "reference_id", "source", "reference_evidence", "peptide", "hla", "panel_hla", "hla_status", "donor_hla_status", "panel_hla_status",
    "cosine_similarity", "cosine_distance", "neighbor_rank", "reason",
]


def eligible_problem(species: str = "human"):
    """Why a receptor isn't embedded, or null: other species, no unambiguous pair, chains left out."""
    return F.coalesce(
        F.when(~F.col("species").eqNullSafe(species), F.concat(F.lit("the species isn't "), F.lit(species))),
        F.when(~F.col("pairing_status").eqNullSafe("paired"), F.concat(F.lit("pairing: "), F.coalesce("pairing_status", F.lit("unknown")))),
        F.when(F.length("unusable_chain_context") > 0, F.concat(F.lit("chains left out: "), F.col("unusable_chain_context"))),
    )


def checked_vectors(df: DataFrame, key: str, vector: str = "vector") -> None:
    """Refuse missing, uneven or unbalanced vectors and repeated keys; one job."""
    sound = (F.size(vector) > 0) & (F.size(vector) % 2 == 0) & unit_norm(vector, 1e-5) & halves_balanced(vector, 1e-5)
    bad, rows, keys, widths = df.agg(F.count_if(~F.coalesce(sound, F.lit(False))), F.count("*"), F.count_distinct(key), F.count_distinct(F.size(vector))).first()
    if bad:
        raise InputError(f"{bad} vectors aren't two chains of equal weight and length 1 together")
    if keys != rows:
        raise InputError(f"{key} is missing or repeated")
    if widths > 1:
        raise InputError("vectors differ in width")


def embedding_evidence(receptors: DataFrame, references: DataFrame, panel: DataFrame, donors: DataFrame, k: int = 10) -> DataFrame:
    """The columns of OUTPUT for receptors (receptor_id, donor_id, vector) and references (reference_id, identity, vector, peptide, hla, source, evidence).

    identity is the lowercase hex SHA-256 of the sequences that were embedded;
    ties go to the smaller one.  Receptors without any reference left have no
    row; a donor without typing leaves the molecule unresolved; extra columns
    aren't read; empty tables give an empty table.
    """
    if not references.filter(~F.coalesce(F.col("identity").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))).isEmpty():
        raise InputError("identity is the hex SHA-256 of a receptor's sequences")
    refs = references.select("reference_id", "identity", "vector", "peptide", "hla", "source", F.col("evidence").alias("reference_evidence"))
    wanted = panel.select("peptide", F.col("hla").alias("panel_hla")).distinct()
    met = refs.select("peptide", "hla").distinct().join(wanted, "peptide")
    contexts = hla.compared(met, "hla", "panel_hla", "panel_hla_status", "_panel_reason").filter("panel_hla_status <> 'incompatible'")
    contexts = staged(contexts.select(F.col("peptide").alias("_p"), F.col("hla").alias("_h"), "panel_hla", "panel_hla_status", "_panel_reason"))
    same = F.col("peptide").eqNullSafe(F.col("_p")) & F.col("hla").eqNullSafe(F.col("_h"))
    untyped = hla.donor_compared(refs.withColumn("_none", F.lit(None).cast("array<string>")), "hla", "_none", "_alone", "_why").filter("_alone <> 'incompatible'")
    kept = staged(untyped.drop("_none", "_alone", "_why").join(contexts, same, "left_semi"))

    number = F.conv(F.substring("identity", 1, 15), 16, 10).cast("long")  # in the order of the identities
    groups = staged(kept.groupBy("identity").agg(F.min_by("vector", "reference_id").alias("vector")).withColumn("ref_id", number))
    checked_vectors(receptors.select("receptor_id", "vector"), "receptor_id")
    checked_vectors(groups, "ref_id")
    near = cosine_top_k(receptors, groups, k, query_id="receptor_id").withColumnRenamed("query_id", "receptor_id")
    near = near.join(groups.select("ref_id", "identity"), "ref_id")

    typing = donors.groupBy("donor_id").agg(F.sort_array(F.collect_set("hla")).alias("_typing"))
    rows = near.join(kept.drop("vector"), "identity").join(receptors.select("receptor_id", "donor_id"), "receptor_id").join(typing, "donor_id", "left")
    rows = hla.donor_compared(staged(rows), "hla", "_typing", "donor_hla_status", "_donor_reason").filter("donor_hla_status <> 'incompatible'").join(contexts, same)
    both = (F.col("donor_hla_status") == "compatible") & (F.col("panel_hla_status") == "compatible")
    reason = F.concat_ws(
        "; ", F.lit("near in the space of embeddings, a hypothesis to be tested"), F.when(F.col("donor_hla_status") != "compatible", F.concat(F.lit("donor: "), F.col("_donor_reason"))),
        F.when(F.col("panel_hla_status") != "compatible", F.concat(F.lit("panel: "), F.col("_panel_reason"))),
    )
    told = {
        "status": F.lit("Experimental"), "evidence_type": F.lit("embedding_neighbor"), "reference_receptor_id": F.concat(F.lit("reconstructed-"), "identity"), "hla_status": F.when(both, "compatible").otherwise("unresolved"),
        "cosine_similarity": F.col("similarity"), "cosine_distance": 1 - F.col("similarity"), "neighbor_rank": F.col("rank").cast("long"), "reason": reason,
    }
    return rows.withColumns(told).select(OUTPUT)
