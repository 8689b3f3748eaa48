"""Memory plans for training layered models, over a table of layers.

layers: (idx bigint, name string, type string, params bigint, activation_bytes bigint); activation
bytes are those of one sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the model: bytes of a parameter, its gradient and its optimiser state; limits' shares for each strategy.
PARAM_BYTES, GRADIENT_BYTES, OPTIMIZER_BYTES = 4, 4, 8
#: Fixed value: the side of the image that a convolution's activations are taken over.
IMAGE_SIDE = 100
HALF_TYPES = ("Linear", "Conv2d", "Dense", "Conv2D")


def shaped_layers(shapes: DataFrame) -> DataFrame:
    """The layers' table from their shapes: (idx, name, type, inputs, outputs, kernel), all but idx, name and type may be null.

    Dense layers have inputs * outputs weights and a bias an output; convolutions a kernel of
    kernel * kernel for each pair of channels. Activations of one sample, in bytes: 4 an output of a
    dense layer, 4 * IMAGE_SIDE ** 2 an output channel of a convolution, 4 a parameter of others.
    """
    n = lambda c, least=0: F.coalesce(F.col(c), F.lit(least)).cast("bigint")
    dense, convolution = F.col("type").isin("Linear", "Dense"), F.col("type").isin("Conv2d", "Conv2D")
    params = F.when(dense, n("inputs") * n("outputs") + n("outputs")).when(convolution, n("inputs") * n("outputs") * n("kernel", 1) * n("kernel", 1) + n("outputs")).otherwise(n("inputs"))
    rows = shapes.withColumn("params", params)
    activation = F.when(dense, n("outputs")).when(convolution, n("outputs") * IMAGE_SIDE * IMAGE_SIDE).otherwise(F.col("params"))
    return rows.select("idx", "name", "type", "params", (activation * 4).alias("activation_bytes"))


def bottlenecks(layers: DataFrame, share: float = 0.2) -> DataFrame:
    """The top share of layers by memory, one at least. Layers are few; they are ranked in one task."""
    memory = F.col("params") * PARAM_BYTES + F.col("activation_bytes")
    ranked = layers.withColumn("memory_bytes", memory).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("memory_bytes"), "idx")))
    n = layers.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share))).scalar()
    return ranked.where(F.col("rank") <= n).select("name", "memory_bytes", "rank")


def segments(layers: DataFrame) -> DataFrame:
    """(name, segment, checkpointed): about sqrt(n) layers a segment; each segment's first layer is kept."""
    root = layers.agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.count(F.lit(1)))))).scalar()
    return layers.select("name", F.floor(F.col("idx") / root).cast("bigint").alias("segment"), (F.col("idx") % root == 0).alias("checkpointed"))


def training_plan(layers: DataFrame, batch: int, limit_bytes: int) -> DataFrame:
    """One row: memory before and after, and which measures apply.

    Checkpointing halves the activations of the kept layers (speed 0.8), mixed precision halves
    all activations (speed 1.5), accumulation splits the batch into steps.
    """
    p = F.sum("params")
    act = F.sum("activation_bytes") * batch
    total = layers.agg(p.alias("params"), act.alias("activations"), F.count(F.lit(1)).alias("n")).withColumn(
        "total", F.col("params") * (PARAM_BYTES + GRADIENT_BYTES + OPTIMIZER_BYTES) + F.col("activations"))
    kept = segments(layers).where("checkpointed").join(layers, "name").agg(F.coalesce(F.sum("activation_bytes"), F.lit(0)) * batch).scalar()
    ratio = F.col("total") / limit_bytes
    plan = total.withColumn("checkpointing", ratio > 0.6).withColumn("mixed_precision", ratio > 0.8).withColumn("accumulation", ratio > 1.0)
    after = F.col("total") - F.when(F.col("checkpointing"), kept / 2).otherwise(0.0) - F.when(F.col("mixed_precision"), F.col("activations") / 2).otherwise(0.0)
    speed = F.when(F.col("checkpointing"), 0.8).otherwise(1.0) * F.when(F.col("mixed_precision"), 1.5).otherwise(1.0)
    planned = plan.withColumn("planned", F.greatest(after, F.lit(0.0)).cast("bigint"))
    return planned.select(F.col("total").cast("bigint").alias("total_bytes"), F.col("planned").alias("planned_bytes"), "checkpointing", "mixed_precision", "accumulation",
                          F.greatest(F.lit(1), F.when(F.col("accumulation"), F.ceil(F.col("planned") / limit_bytes)).otherwise(1)).cast("bigint").alias("steps"), speed.alias("speed"))


def half_precision(layers: DataFrame) -> DataFrame:
    return layers.select("name", F.col("type").isin(*HALF_TYPES).alias("half"))
