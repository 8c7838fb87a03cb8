"""Chat formatting by perspective rotation (operator 3).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; the mask covers what
the assistant says (its text and end mark).  System turns are instructions:
they stand in every rendering and are nobody's perspective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"
BLOCK_TURNS = 256
PART_ROWS = 1024
#: Of a part's number: the turn in its block, then the hash of its rows, then the copies of one row.
_TURN, _HASH = 1 << 40, 1 << 20


def escaped(name: Column) -> Column:
    """A speaker's name that can't close its own tag or start another."""
    out = F.replace(F.replace(name, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.translate(out, "\n\r", "  ")


def _parted(clean: DataFrame, most: int, block_turns: int) -> DataFrame:
    """clean with the part of its block that each row is in: 0, but in blocks of more than `most` rows.

    Those are parted by turn, a turn of more than `most` rows by a hash of
    speaker and text, and more than `most` equal rows by their number: equal
    rows are counted first, so no task gathers them.
    """
    key = ["conv_id", "block"]
    sized = clean.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("conv_id").alias("h_conv"), F.col("block").alias("h_block"))
    hot = (clean["conv_id"].eqNullSafe(sized["h_conv"])) & (clean["block"] == sized["h_block"])
    calm = clean.join(sized, hot, "left_anti").withColumn("part", F.lit(0).cast("long"))
    same = clean.join(sized, hot, "left_semi").groupBy("conv_id", "turn", "speaker", "text", "block").agg(F.count(F.lit(1)).alias("copies"))
    turns = same.groupBy(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn")).agg(F.sum("copies").alias("rows"))
    met = same.join(turns, same["conv_id"].eqNullSafe(turns["t_conv"]) & (same["turn"] == turns["t_turn"]))
    ways = F.ceil(F.col("rows") / most)
    hashed = F.pmod(F.crc32(F.concat_ws("\x01", "speaker", "text").cast("binary")), ways)
    slabs = met.withColumn("slab", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("copies") / most) - 1).cast("int"))))
    part = (F.col("turn") - F.col("block") * block_turns) * _TURN + hashed * _HASH + F.col("slab")
    each = slabs.withColumn("part", part.cast("long")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("copies") - F.col("slab") * most).cast("int"))))
    return calm.unionByName(each.select(calm.columns))


def rotate_perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS, part_rows: int = PART_ROWS, system_role: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, block, part, n_turns, rendered, mask, n_masked: a row per participant, block and part.

    A block holds the turns numbered k * block_turns to (k + 1) * block_turns - 1.
    It is one part (0) unless it has over part_rows rows, as where many turns
    have no number; then its turns, and the rows of one turn, are several.  The
    parts of a perspective, joined in order of block and part, are its whole
    rendering, and a conversation of any length is never gathered in one task.
    mask lists start:end in code points of its part's text, comma-joined.  Null
    turn numbers count as -1, a null speaker is called `unknown`, a null text is
    empty; ties are ordered by part, speaker and text; repeated rows all stand; a
    null conv_id is a conversation like others.  `<|` inside a text is written
    `< |`, and in a speaker's name also `|>` as `| >` and line ends as spaces, so
    nothing said or called can end its own turn; perspective has the name as it
    is.  A conversation of system turns only, and an empty table, give no row.
    """
    clean = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / block_turns).cast("long"))
    own = clean.filter(F.col("speaker") != system_role).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    rotated = _parted(clean, part_rows, block_turns).join(own, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(mine, "<|assistant|>\n").when(F.col("speaker") == system_role, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), escaped(F.col("speaker")), F.lit("|>\n")))
    parts = rotated.select("conv_id", "perspective", "block", "part", "turn", "speaker", "text", mine.alias("mine"), F.length(head).alias("head"), F.concat(head, "text", F.lit(END + "\n")).alias("segment"))
    group = ["conv_id", "perspective", "block", "part"]
    order = Window.partitionBy(*group).orderBy("turn", "speaker", "text")
    placed = parts.withColumn("ordinal", F.row_number().over(order)).withColumn("upto", F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("upto") - F.length("segment") + F.col("head")
    span = F.when(F.col("mine"), F.concat_ws(":", begin.cast("string"), (F.col("upto") - 1).cast("string")))
    listed = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("ordinal", "segment", span.alias("span")))).alias("items"),
        F.coalesce(F.sum(F.when(F.col("mine"), F.col("upto") - 1 - begin)), F.lit(0)).cast("long").alias("n_masked"),
    )
    return listed.select(
        *group, "n_turns", F.array_join(F.col("items.segment"), "").alias("rendered"), F.array_join(F.col("items.span"), ",").alias("mask"), "n_masked"
    )


def oracle_sql(block_turns: int = BLOCK_TURNS) -> str:
    """The same over the table conversations, whose blocks have at most PART_ROWS rows."""
    return f"""
with clean as (select conv_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as text,
  cast(floor(coalesce(turn, -1) / {block_turns}.0) as bigint) as block from conversations),
own as (select distinct conv_id as p_conv, speaker as perspective from clean where speaker <> 'system'),
parts as (select conv_id, perspective, block, turn, speaker, text, speaker = perspective as mine,
  case when speaker = perspective then '<|assistant|>' when speaker = 'system' then '<|system|>' else '<|user name=' || translate(replace(replace(speaker, '<|', '< |'), '|>', '| >'), chr(10) || chr(13), '  ') || '|>' end || chr(10) as head
  from clean join own on conv_id is not distinct from p_conv),
segments as (select *, head || text || '{END}' || chr(10) as segment from parts),
placed as (select *, row_number() over w as ordinal, sum(length(segment)) over (w rows unbounded preceding) as upto from segments
  window w as (partition by conv_id, perspective, block order by turn, speaker, text))
select conv_id, perspective, block, cast(0 as bigint) as part, count(*) as n_turns, string_agg(segment, '' order by ordinal) as rendered,
  coalesce(string_agg(cast(upto - length(segment) + length(head) as bigint) || ':' || cast(upto - 1 as bigint), ',' order by ordinal) filter (where mine), '') as mask,
  cast(coalesce(sum(case when mine then length(segment) - length(head) - 1 else 0 end), 0) as bigint) as n_masked
from placed group by conv_id, perspective, block"""
