"""Two-stage decisions and metric ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the first cascade: the edge is unsure strictly between these probabilities.
UNSURE_LOW, UNSURE_HIGH = 0.4, 0.6

# Fixed values of the second cascade: escalate above, raise the alarm at or above.
ESCALATE_ABOVE, ALARM_FROM = 0.3, 0.95


def predicted(p: Column) -> Column:
    """Class of a probability; a tie is normal."""
    return F.when(p > 0.5, 1).otherwise(0)


def escalate_unsure(p_edge: Column) -> Column:
    """Escalate when the edge says attack or is unsure."""
    return (predicted(p_edge) == 1) | ((p_edge > UNSURE_LOW) & (p_edge < UNSURE_HIGH))


def cascade_replace(p_edge: Column, central_class: Column) -> Column:
    """The central class replaces the edge class on escalated rows."""
    return F.when(escalate_unsure(p_edge), central_class).otherwise(predicted(p_edge))


def escalate_suspicious(p_edge: Column, above: float = ESCALATE_ABOVE) -> Column:
    """Escalate when the edge probability is above a low threshold."""
    return p_edge > above


def cascade_confirm(
    p_edge: Column, p_central: Column, above: float = ESCALATE_ABOVE, confirm: float = ALARM_FROM
) -> Column:
    """Attack only when escalated and confirmed by a confident central model."""
    return F.when(escalate_suspicious(p_edge, above) & (p_central >= confirm), 1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)
