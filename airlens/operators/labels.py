"""Attack spans from control messages and labels on packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.scalars import strip
from airlens.operators.scan import cell_of

SPAN_CELL_US = 10_000_000


def parse_control(control: DataFrame) -> DataFrame:
    """Status and attack type of each message: JSON, or plain START/STOP."""
    text = strip(F.col("payload"))
    body = F.from_json(text, "status string, attack_type string", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    parsed = control.withColumn("_b", body)
    plain = text.isin("START", "STOP")
    return parsed.withColumns({
        "status": F.coalesce(F.col("_b.status"), F.when(plain, text)),
        "attack_type": F.when(plain, F.when(text == "START", "GENERIC_ATTACK")).otherwise(
            F.when(F.col("_b.status") == "START", F.coalesce(F.col("_b.attack_type"), F.lit("UNKNOWN")))
        ),
    }).drop("_b")


def control_to_spans(control: DataFrame, key: str = "capture_id") -> DataFrame:
    """One span per START.

    ``state`` is closed (a STOP follows), lost (another START follows: it only labels what
    arrives before that) or open (nothing follows). Control messages are a few per round, so
    a plain window over the capture is used.
    """
    told = parse_control(control).where(F.col("status").isin("START", "STOP"))
    w = Window.partitionBy(key).orderBy("arrival_us", "seq_no")
    told = told.withColumns({
        "_next": F.lead("status").over(w), "_at": F.lead("arrival_us").over(w),
    }).where("status = 'START'")
    spans = told.select(
        key, "seq_no", F.col("arrival_us").alias("start_us"),
        F.when(F.col("_next") == "STOP", F.col("_at")).alias("end_us"),
        F.when(F.col("_next") == "START", F.col("_at")).alias("valid_until_us"),
        "attack_type",
    ).withColumn(
        "state",
        F.when(F.col("end_us").isNotNull(), "closed").when(F.col("valid_until_us").isNotNull(), "lost").otherwise("open"),
    )
    earlier = Window.partitionBy(key).orderBy("start_us", "seq_no").rowsBetween(Window.unboundedPreceding, -1)
    # Where an earlier round ends exactly at this start, the earlier one owns that instant.
    return spans.withColumn(
        "start_shared", F.coalesce(F.max("end_us").over(earlier) == F.col("start_us"), F.lit(False))
    )


def _by_cell(spans: DataFrame, cell_us: int) -> DataFrame:
    last = F.coalesce("end_us", "valid_until_us")
    lo, hi = cell_of("start_us", cell_us), cell_of(last, cell_us)
    return spans.withColumn("_cell", F.explode(F.sequence(lo, hi)))


def label_packets(
    packets: DataFrame,
    spans: DataFrame,
    key: str = "capture_id",
    time: str = "aligned_us",
    arrival: str = "arrival_us",
    cell_us: int = SPAN_CELL_US,
) -> DataFrame:
    """0/1 and type of each packet from the span its generation time lies in.

    Bounded spans are cut into time cells and joined on (capture, cell), so a busy capture
    spreads over its cells. A capture has at most one open span, joined on the capture. Spans
    of a capture touch only at their ends, so a packet meets one span at most and nothing has
    to be grouped again. Spark picks broadcast or shuffle from the size of the span table.
    """
    keep = ["start_us", "end_us", "valid_until_us", "attack_type", "start_shared"]
    bounded = _by_cell(spans.where("state <> 'open'"), cell_us).select(
        F.col(key).alias("_k"), "_cell", *[F.col(c).alias(f"_s_{c}") for c in keep]
    )
    tail = spans.where("state = 'open'").select(
        F.col(key).alias("_ok"), F.col("start_us").alias("_o_start"),
        F.col("attack_type").alias("_o_type"), F.col("start_shared").alias("_o_shared"),
    )
    p = packets.drop("label", "attack_type")
    t, a = F.col(time), F.col(arrival)
    inside = (
        (F.col(key) == F.col("_k")) & (cell_of(time, cell_us) == F.col("_cell"))
        & ((t > F.col("_s_start_us")) | ((t == F.col("_s_start_us")) & ~F.col("_s_start_shared")))
        & F.when(F.col("_s_end_us").isNotNull(), t <= F.col("_s_end_us")).otherwise(a < F.col("_s_valid_until_us"))
    )
    running_on = (F.col(key) == F.col("_ok")) & (
        (t > F.col("_o_start")) | ((t == F.col("_o_start")) & ~F.col("_o_shared"))
    )
    kind = F.coalesce("_s_attack_type", "_o_type")
    hit = F.col("_k").isNotNull() | F.col("_ok").isNotNull()
    return p.join(bounded, inside, "left").join(tail, running_on, "left").withColumns({
        "label": hit.cast("int"), "attack_type": F.when(hit, kind).otherwise("NONE"),
    }).drop("_k", "_cell", "_ok", "_o_start", "_o_type", "_o_shared", *[f"_s_{c}" for c in keep])


def attack_rounds(
    labelled: DataFrame, spans: DataFrame, key: str = "capture_id", arrival: str = "arrival_us", cell_us: int = SPAN_CELL_US
) -> DataFrame:
    """Type, length and attack packets that arrived during each closed round."""
    closed = spans.where("state = 'closed'")
    cells = _by_cell(closed, cell_us).select(F.col(key).alias("_k"), "_cell", "start_us", "seq_no", "end_us")
    hits = labelled.where("label = 1").select(key, arrival)
    counted = hits.join(
        cells,
        (F.col(key) == F.col("_k")) & (cell_of(arrival, cell_us) == F.col("_cell"))
        & (F.col(arrival) >= F.col("start_us")) & (F.col(arrival) < F.col("end_us")),
    ).groupBy(key, "start_us", "seq_no").agg(F.count(F.lit(1)).alias("n_packets"))
    return closed.join(counted, [key, "start_us", "seq_no"], "left").select(
        key, "start_us", "end_us", "attack_type",
        ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("duration_s"),
        F.coalesce("n_packets", F.lit(0)).alias("n_packets"),
    )


def relabel_missed_stop(
    packets: DataFrame,
    kind: str = "SYN_FLOOD",
    keep_seconds: float = 130.0,
    key: str = "capture_id",
    time: str = "gen_us",
    row_no: str = "pkt_id",
) -> DataFrame:
    """Clear the label of rows of ``kind`` later than the first such row plus ``keep_seconds``.

    The first row is the first in file order with a readable time; one start per capture.
    """
    of_kind = (F.col("attack_type") == kind) & (F.col("label").cast("string") == "1") & F.col(time).isNotNull()
    start = packets.where(of_kind).groupBy(key).agg(F.min_by(time, row_no).alias("_t0"))
    late = of_kind & (F.col(time) - F.col("_t0") > int(round(keep_seconds * 1e6)))
    late = F.coalesce(late, F.lit(False))
    return packets.join(start, key, "left").withColumn("_late", late).withColumns({
        "label": F.when(F.col("_late"), F.lit("0").cast(packets.schema["label"].dataType)).otherwise(F.col("label")),
        "attack_type": F.when(F.col("_late"), "NONE").otherwise(F.col("attack_type")),
    }).drop("_t0", "_late")
