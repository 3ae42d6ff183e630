"""Whole runs: raw model texts to audits, boxes to training records, raw corpora to curated ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..functions.json_lists import parsed_list
from ..functions.prompts import attempt_prompt, draft_prompt, grounding_prompt
from ..functions.scalars import without_reasoning
from ..functions.vocab import CANONICAL, POSITIVE, canonical_ord, label_bit, normalized_finding, stripped
from . import findings, matching, sampling
from .audit import DRAFT_NOTE, FLAGS
from .audit import flags_of as audit_flags
from .corpus import assistant_text, chat_record, target_text
from .scratch import settled

#: A model: (prompt, attempt number) -> text, null for a null prompt without any work.
Generate = Callable[[Column, int], Column]
GROUNDING_ATTEMPTS, DRAFT_ATTEMPTS = 3, 2


def generated(rows: DataFrame, prompt: Column, generate: Generate, attempts: int) -> DataFrame:
    """Add ``parse`` (ok, error, elements) and ``attempt`` of the first attempt that reads.

    Every attempt is a table of its own in the shared folder: the first of all rows, each
    further one of the rows that the one before could not read.  A model is asked once for
    each row and attempt, whoever reads the result and however often; all readers see the
    same answer.  A null prompt gives a null parse.  If no attempt reads, parse is that of
    the last.
    """
    asked, done = rows.withColumn("_prompt", prompt), None
    for n in range(1, attempts + 1):
        said = generate(attempt_prompt(F.col("_prompt"), F.lit(n)), n)
        read = F.when(F.col("_prompt").isNotNull(), parsed_list(without_reasoning(said)))
        made = asked.withColumns({"parse": read, "attempt": F.when(F.col("_prompt").isNotNull(), F.lit(n))})
        # a prompt is kept for the rows alone that are asked again
        table = settled(made.withColumn("_prompt", F.when(~F.col("parse.ok"), F.col("_prompt"))), f"attempt-{n}")
        over = F.col("_prompt").isNull()
        asked = table.filter(~over).drop("parse", "attempt")
        last = n == attempts or asked.isEmpty()
        mine = table if last else table.filter(over)
        done = mine if done is None else done.unionByName(mine)
        if last:
            break
    return done.drop("_prompt")


def drafts_read(drafts: DataFrame, generate: Generate, text: str = "draft", attempts: int = DRAFT_ATTEMPTS) -> DataFrame:
    """Drafts with the parse of what a model says they state; blank drafts have none."""
    said = F.coalesce(stripped(F.col(text)), F.lit("")) != ""
    return generated(drafts, F.when(said, draft_prompt(F.when(said, F.col(text)).otherwise("-"))), generate, attempts)


def images_read(images: DataFrame, generate: Generate, attempts: int = GROUNDING_ATTEMPTS) -> DataFrame:
    """Images with the parse of a model's findings; the model closes over the image's column."""
    return generated(images, grounding_prompt(), generate, attempts)


def audits_of(grounded: DataFrame, drafted: DataFrame | None = None, id_col: str = "image_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The audit of every image from parsed texts: id, ok, the flags, unsupported_spans, draft_note, and ``keep`` of ``grounded``.

    ``grounded``: id, parse - a row for each image.  ``drafted``: id, parse (null: no draft).
    An image whose findings cannot be read has ok false and null flags.  A draft that cannot
    be read leaves the audit to the image alone and gives it a note.

    A text's labels and claims are taken within its row, so both tables are read once and
    meet in one shuffle and one sort by id; rows of one id share their findings.
    """
    ok, elements = F.coalesce("parse.ok", F.lit(False)), F.col("parse.elements")
    bits = lambda found: F.aggregate(found, F.lit(0), lambda acc, x: acc.bitwiseOR(x))
    mine = grounded.select(id_col, *keep, ok.alias("ok"), bits(F.transform(findings.image_labels(elements), label_bit)).alias("image"))
    rows = mine.withColumn("_asked", F.lit(True))
    if drafted is not None:
        claims = drafted.select(id_col, findings.first_claims(elements).alias("_claims"), (~F.col("parse.ok")).alias("_failed"))
        rows = rows.unionByName(claims.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    else:
        rows = rows.withColumns({"_claims": F.lit(None).cast("array<struct<ord:int,span:string>>"), "_failed": F.lit(None).cast("boolean")})
    whole = Window.partitionBy(id_col)
    firsts = {f"_first_{i}": F.min(F.get("_claims", F.lit(i))).over(whole) for i in range(len(POSITIVE))}
    per = rows.filter(F.col(id_col).isNotNull()).withColumns({"image": F.bit_or("image").over(whole), "_noted": F.max("_failed").over(whole), **firsts}).filter("_asked")
    said = [F.col(c) for c in firsts]
    draft = sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(said[1:], 1)), F.when(said[0].isNotNull(), 1).otherwise(0))
    flags = audit_flags(F.col("image"), draft, [c["span"] for c in said])
    names = (*FLAGS, "unsupported_spans")
    note = F.when(F.col("_noted"), DRAFT_NOTE).alias("draft_note")
    out = per.select(id_col, *keep, "ok", *flags, note)
    return out.select(id_col, "ok", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in (*names, "draft_note")], *keep)


def curated_findings(rows: DataFrame, merge: float = 0.5, cross: float = 0.6, id_col: str = "image_id") -> DataFrame:
    """id, ord, finding, box: connected boxes of a label merged, then overlaps between labels resolved.

    A label without any box stands once, without a box.  ``ord`` follows the labels'
    canonical order, then the first place of each merged box.
    """
    merged = matching.merged_boxes(rows, merge, id_col).select(id_col, "finding", F.col("cluster").cast("long").alias("cluster"), "box")
    bare = rows.groupBy(id_col, "finding").agg(F.count("box").alias("n")).filter("n = 0").select(id_col, "finding")
    both = merged.unionByName(bare.withColumn("cluster", F.lit(0).cast("long")), allowMissingColumns=True)
    ordered = both.withColumn("ord", F.shiftleft(canonical_ord(F.col("finding")).cast("long"), 40) + F.col("cluster"))
    return matching.cross_label_resolved(ordered, cross, id_col).select(id_col, "ord", "finding", "box")


def record_findings(records: DataFrame, id_col: str, record: str = "record") -> DataFrame:
    """id, ord, finding, box of the targets of training records; a target that cannot be read is an error."""
    parsed = records.select(id_col, parsed_list(assistant_text(F.col(f"{record}.messages"))).alias("parse"))
    error = F.raise_error(F.concat(F.lit("target of "), F.col(id_col).cast("string"), F.lit(": "), F.col("parse.error"))).cast("array<string>")
    whole = parsed.select(id_col, F.posexplode(F.when(F.col("parse.ok"), F.col("parse.elements")).otherwise(error)).alias("ord", "element"))
    v = F.try_parse_json("element")
    label = normalized_finding(F.try_variant_get(v, "$.label", "string"), strict=True)
    return whole.select(id_col, "ord", label.alias("finding"), valid_box(F.try_variant_get(v, "$.box_2d", "array<double>")).alias("box"))


def training_rows(ids: DataFrame, rows: DataFrame, path: Column, prompt: Column, id_col: str = "image_id") -> DataFrame:
    """``ids`` (a row for each image) with ``record``: the two-turn record with its findings as the target."""
    whole = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("confidence", "double"), ("evidence", "string")) if c not in rows.columns})
    if "status" not in rows.columns:
        whole = whole.withColumn("status", F.lit("present"))
    targets = target_text(ids, whole, id_col).withColumnRenamed("target", "_target")
    return ids.join(targets, id_col).withColumn("record", chat_record(path, prompt, F.col("_target"))).drop("_target")


def curated_corpus(records: DataFrame, prompt: Column, merge: float = 0.5, ratio: float = 1.0, fraction: float = 0.1, seed: int = 0, cross: float = 0.6, id_col: str = "id", record: str = "record") -> DataFrame:
    """id, split, signature, record: a raw corpus merged, resolved, balanced and split.

    ``records``: a unique id and the record.  The split sees the curated labels of the
    balanced rows.  Parsed targets, curated findings and the balanced ids are checkpointed,
    as each is read by several of the steps after it.
    """
    read = settled(record_findings(records, id_col, record))
    rows = settled(curated_findings(read, merge, cross, id_col).withColumn("status", F.lit("present")))
    kept = settled(sampling.balanced(findings.label_sets(records, rows, id_col), ratio, seed, id_col))
    split = sampling.stratified_split(kept, fraction, seed, id_col).select(id_col, "split", "signature")
    chosen = records.select(id_col, F.col(f"{record}.image_path").alias("_path")).join(split, id_col)
    made = training_rows(chosen, rows, F.col("_path"), prompt, id_col)
    return made.select(id_col, "split", "signature", "record")


def prepared_corpus(first: DataFrame, second: DataFrame, path: Column, prompt: Column, id_col: str = "image_id") -> DataFrame:
    """id, record: the boxes of a first source with what a second one adds, an image a record.

    ``first`` and ``second``: id, ord, finding, box.  Images come from the first source, also
    those of its rows without a finding; what the second adds stands after it.
    """
    merged = findings.merged_findings(first, second, id_col)
    known = merged.filter(F.col("finding").isin(*CANONICAL)).withColumn("ord", F.struct("source", "ord"))
    return training_rows(first.select(id_col).distinct(), known, path, prompt, id_col)
