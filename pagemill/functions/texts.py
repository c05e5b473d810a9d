"""Texts of page and document results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result texts, as stored and shown to users. %s/%d are filled per row.
ERROR_PREFIXES = (
    ("OCR failed", "OCR Timeout ou Erreur: "),
    ("Image not found", "Image non trouvée: "),
)
MISSING_FAILED = (
    "Page non traitée - La tâche a échoué après %d/%d tentatives et a été envoyée dans la Dead Letter Queue. "
    "Message ID: %s"
)
MISSING_TIMEOUT = (
    "Page non traitée - Timeout global (%ds) atteint avant que la page ne soit traitée. "
    "La tâche peut encore être en cours ou avoir échoué silencieusement."
)
MISSING_UNKNOWN = "Résultat non disponible dans Redis - La page n'a pas été traitée ou le résultat a expiré"
ALL_OK = "Toutes les pages ont été traitées avec succès (%d/%d)"
ALL_FAILED = "Toutes les pages ont échoué (%d/%d)"
PARTIAL = "Traitement partiel: %d page(s) réussie(s), %d page(s) échouée(s) sur %d total"
MISSING_LIST = ". Pages manquantes: "
DEADLINE_NOTE = " [TIMEOUT: Le timeout global de %ds a été atteint]"
PAGE_OK = "Page %d: OK - %s (confiance: %.2f%%)"
PAGE_ERROR = "Page %d: ERREUR - %s"
NO_TYPE = "None"


def explained_error(error: Column) -> Column:
    """Known causes get a readable prefix; the first matching rule counts."""
    first, second = ERROR_PREFIXES
    return (
        F.when(F.contains(error, F.lit(first[0])), F.concat(F.lit(first[1]), error))
        .when(F.contains(error, F.lit(second[0])), F.concat(F.lit(second[1]), error))
        .otherwise(error)
    )


def page_summary(number: Column, document_type: Column, confidence: Column, error: Column) -> Column:
    done = F.format_string(PAGE_OK, number, F.coalesce(document_type, F.lit(NO_TYPE)), confidence * 100)
    return F.when(error.isNotNull() & (error != ""), F.format_string(PAGE_ERROR, number, error)).otherwise(done)


def document_status(ok: Column, failed: Column) -> Column:
    return F.when(failed == 0, "success").when(ok == 0, "error").otherwise("partial_success")


def document_message(ok: Column, failed: Column, total: Column, late: Column, deadline_s: int) -> Column:
    """Status message without the list of missing pages, which ``missing_list`` gives block by block."""
    base = (
        F.when(failed == 0, F.format_string(ALL_OK, ok, total))
        .when(ok == 0, F.format_string(ALL_FAILED, failed, total))
        .otherwise(F.format_string(PARTIAL, ok, failed, total))
    )
    note = F.when(late, F.format_string(DEADLINE_NOTE, F.lit(deadline_s))).otherwise("")
    return F.concat(base, note)


def missing_list(numbers: Column) -> Column:
    """Text of missing page numbers, empty when there is none."""
    listed = F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", ")
    return F.when(F.size(numbers) > 0, F.concat(F.lit(MISSING_LIST), listed)).otherwise("")
