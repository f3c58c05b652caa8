"""Three-valued claims about one service, as Column expressions.

NULL means "nobody has said" and is never turned into false. A test such as ``~filled`` is
NULL when ``filled`` is NULL, which is exactly what the rules below need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewait.params import BANDS, MOVING_WORDS, STOPPED_WORDS

WAITED = ("waited_1", "waited_2plus")
MISSED = ("waited_1", "waited_2plus", "filled")

# Wording the board publishes.
FULL_NOTE = r"(?i)loading maximum number of vehicles"
DEPARTED_NOTE = r"(?i)\bdeparted\b[^\d]{0,12}(\d{1,2}):(\d{2})\s*(am|pm|a\.m\.|p\.m\.)?"


def is_moving(status: Column, speed: Column) -> Column:
    """True moving, false stopped, NULL when neither the word nor the speed speaks."""
    word = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(word.isin(*MOVING_WORDS), True)
        .when(word.isin(*STOPPED_WORDS), False)
        .otherwise(speed > 0)
    )


def usable_reading(confidence: Column, visible: Column, band: Column, visibility: Column,
                   count: Column, minimum: float) -> Column:
    """A reading with a `visible` flag is judged on its band, an older one on its count."""
    newer = visible & band.isNotNull()
    older = ~F.coalesce(visibility, F.lit("")).isin("dark", "obscured") & count.isNotNull()
    return (F.coalesce(confidence, F.lit(0.0)) >= minimum) & F.when(
        visible.isNotNull(), newer
    ).otherwise(older)


def says_full(status_text: Column) -> Column:
    return F.coalesce(status_text.rlike(FULL_NOTE), F.lit(False))


def says_departed(status_text: Column) -> Column:
    return F.coalesce(status_text.rlike(DEPARTED_NOTE), F.lit(False))


def row_departed(departed_hhmm: Column, status_text: Column) -> Column:
    return departed_hhmm.isNotNull() | says_departed(status_text)


def occupied(band: Column, count: Column) -> Column:
    return F.when(band.isNotNull(), band != "empty").otherwise(count > 0)


def band_rank(band: Column) -> Column:
    """1 for the emptiest band; NULL for an unknown label."""
    position = F.array_position(F.array(*[F.lit(b) for b in BANDS]), band)
    return F.when(position > 0, position)


def band_of_rank(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(b) for b in BANDS]), rank.cast("int")))


def outcome_from_axes(filled: Column, left_behind: Column, cancelled: Column, waited: Column) -> Column:
    return (
        F.when(cancelled, "cancelled")
        .when(waited.isin(*WAITED), waited)
        .when(filled, "filled")
        .when(~filled | ~left_behind, "boarded")
        .otherwise("unknown")
    )


def axes_from_outcome(outcome: Column) -> tuple[Column, Column]:
    """(filled, left_behind) a single word implies."""
    filled = F.when(outcome.isin(*MISSED), True).when(outcome == "boarded", False)
    left = F.when(outcome.isin(*WAITED), True).when(outcome == "boarded", False)
    return filled, left


def effective_axes(filled: Column, left_behind: Column, outcome: Column) -> tuple[Column, Column]:
    """Stored axes, or both implied ones when neither was ever stored."""
    implied_filled, implied_left = axes_from_outcome(outcome)
    unset = filled.isNull() & left_behind.isNull()
    return (
        F.when(unset, implied_filled).otherwise(filled),
        F.when(unset, implied_left).otherwise(left_behind),
    )


EVIDENCE_KINDS = ("frames", "report", "import", "deck_space")


def evidence_kind(method: Column) -> Column:
    """Which kind of source a method names; NULL when it names none."""
    chain = F.when(method.startswith(EVIDENCE_KINDS[0]), EVIDENCE_KINDS[0])
    for kind in EVIDENCE_KINDS[1:]:
        chain = chain.when(method.startswith(kind), kind)
    return chain


def evidence_of(kinds: Column) -> Column:
    """One word for an array of kinds: itself, `mixed` or `unknown`."""
    known = F.array_distinct(F.array_compact(kinds))
    return (
        F.when(F.size(known) == 1, F.try_element_at(known, F.lit(1)))
        .when(F.size(known) > 1, "mixed")
        .otherwise("unknown")
    )


@dataclass(frozen=True)
class CameraVerdict:
    """What the camera alone supports."""

    outcome: Column
    cancelled: Column
    carryover: Column

    def struct(self) -> Column:
        return F.struct(
            self.outcome.alias("outcome"),
            self.cancelled.alias("cancelled"),
            self.carryover.cast("int").alias("carryover"),
        )


def classify_counts(residual: Column, at_departure: Column, seen: Column, still_at_dock: Column,
                    berth_visible: Column, capacity: int, threshold: int) -> CameraVerdict:
    """Counts: what was left after the vessel had gone decides."""
    silent = residual.isNull() | at_departure.isNull() | still_at_dock
    outcome = (
        F.when(silent, "unknown")
        .when(residual < threshold, "boarded")
        .when(~seen & berth_visible, "cancelled")
        .when(~seen, "unknown")
        .when(residual > capacity, "waited_2plus")
        .otherwise("waited_1")
    )
    return CameraVerdict(
        outcome,
        outcome == "cancelled",
        F.when(outcome == "boarded", 0).when(outcome != "unknown", residual),
    )


def classify_bands(residual: Column, at_departure: Column, seen: Column, still_at_dock: Column,
                   berth_visible: Column, empty_when_left: Column,
                   clear_needs_departure: Column) -> CameraVerdict:
    """Bands: as counts, but a band can never say how many services somebody waited."""
    silent = residual.isNull() | at_departure.isNull() | still_at_dock
    bare = residual == "empty"
    outcome = (
        F.when(silent, "unknown")
        .when(bare & clear_needs_departure & ~seen, "unknown")
        .when(bare, "boarded")
        .when(~seen & berth_visible, "cancelled")
        .when(~seen, "unknown")
        .when(empty_when_left, "boarded")
        .otherwise("filled")
    )
    return CameraVerdict(outcome, outcome == "cancelled", F.when(outcome == "boarded", 0))


def outcome_of_reports(n: Column, any_missed: Column, longest_wait: Column) -> Column:
    """One person left behind outweighs any number who got on."""
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(~any_missed, "boarded")
        .when(longest_wait >= 2, "waited_2plus")
        .when(longest_wait >= 1, "waited_1")
        .otherwise("filled")
    )


def report_confidence(n: Column) -> Column:
    return F.round(F.least(F.lit(0.95), F.lit(0.8) + F.lit(0.05) * n), 2)


def merge_claims(camera: Column, camera_cancelled: Column, deck: Column, note_full: Column,
                 reported: Column) -> dict[str, Column]:
    """Each source writes only the axis it can witness.

    `deck` is the board's own verdict, `note_full` its capacity note, `reported` the outcome
    of first-hand reports. Any report proves the service ran; a cancelled service has neither
    axis.
    """
    missed = F.coalesce(reported.isin(*MISSED), F.lit(False))
    camera_missed = camera.isin(*MISSED)
    noted = F.coalesce(note_full, F.lit(False))
    cancelled = reported.isNull() & (camera_cancelled | (deck == "cancelled"))
    filled = F.when(missed | noted | (deck == "filled") | camera_missed, True).when(
        deck == "boarded", False
    )
    left_behind = F.when(missed | camera_missed, True).when(
        (camera == "boarded") | F.coalesce(reported == "boarded", F.lit(False)), False
    )
    waited = F.when(missed, F.when(reported.isin(*WAITED), reported)).otherwise(
        F.when(camera.isin(*WAITED), camera)
    )
    live = ~cancelled
    return {
        "cancelled": cancelled,
        "filled": F.when(live, filled),
        "left_behind": F.when(live, left_behind),
        "waited": F.when(live, waited),
    }
