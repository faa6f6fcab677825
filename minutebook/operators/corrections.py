"""Corrections as joins with a table of patches.

Every function returns the new version of the table; nothing is edited in
place.  Patches that match no row are available from :func:`unmatched`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.functions.news import NEWS_TYPES, news_type


def _keyed(patches: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One patch per key: the last non-NULL value of every field, by ``seq`` if given."""
    order = F.col("seq") if "seq" in patches.columns else F.lit(0)
    return patches.groupBy(*key).agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f"_p_{f}") for f in fields])


def patch_items(items: DataFrame, patches: DataFrame, key=("date", "id")) -> DataFrame:
    """Set sponsors, description or final action; NULL leaves a field alone.

    Setting a non-empty sponsor list marks the confidence as ``manual``.
    """
    fields = [f for f in ("sponsors", "description", "finalAction") if f in patches.columns]
    df = items.join(_keyed(patches, list(key), fields), list(key), "left")
    if "sponsors" in fields:
        df = df.withColumn("sponsorConfidence", F.when(
            F.size(F.col("_p_sponsors")) > 0, "manual").otherwise(F.col("sponsorConfidence")))
    for f in fields:
        df = df.withColumn(f, F.coalesce(f"_p_{f}", f)).drop(f"_p_{f}")
    return df.select(*items.columns)


def unmatched(rows: DataFrame, patches: DataFrame, key=("date", "id")) -> DataFrame:
    return patches.join(rows.select(*key), list(key), "left_anti")


def merge_sponsors(items: DataFrame, variations, canonical: str) -> DataFrame:
    """Rename sponsor spellings; rows that had one are de-duplicated in order."""
    if len(variations) < 2 or not canonical:
        raise ValueError("a merge needs a canonical name and at least two variations")
    names = F.array(*[F.lit(v) for v in variations])
    touched = F.coalesce(F.arrays_overlap("sponsors", names), F.lit(False))
    renamed = F.array_distinct(F.transform("sponsors", lambda s: F.when(
        s.isin(*variations), canonical).otherwise(s)))
    return (items.withColumn("_hit", touched)
            .withColumn("sponsors", F.when(F.col("_hit"), renamed).otherwise(F.col("sponsors")))
            .withColumn("sponsorConfidence", F.when(F.col("_hit"), "manual")
                        .otherwise(F.col("sponsorConfidence")))
            .withColumnRenamed("_hit", "touched"))


def delete_sponsor(items: DataFrame, name: str) -> DataFrame:
    has = F.coalesce(F.array_contains("sponsors", name), F.lit(False))
    return (items.withColumn("touched", has)
            .withColumn("sponsors", F.when(F.col("touched"), F.array_remove("sponsors", name))
                        .otherwise(F.col("sponsors"))))


def merge_final_actions(items: DataFrame, variations, canonical: str,
                        action: str = "finalAction") -> DataFrame:
    wanted = ["" if v == "(empty)" else v for v in variations]
    hit = F.coalesce(F.col(action), F.lit("")).isin(*wanted)
    return (items.withColumn("touched", hit)
            .withColumn(action, F.when(F.col("touched"), canonical).otherwise(F.col(action))))


DONATION_FIELDS = ("donation_direction", "donation_type", "amount", "donor", "recipient",
                   "item_donated", "purpose", "excluded")


def parse_amount(raw: Column) -> tuple[Column, Column]:
    """(value, accepted): "1,000" is 1000, '' clears, other text is refused."""
    plain = F.replace(raw, F.lit(","), F.lit(""))
    value = plain.try_cast("decimal(18,2)")
    return value, raw.isNull() | (raw == "") | value.isNotNull()


def patch_donations(donations: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Apply (id, field, value) patches to the editable columns.

    A refused amount leaves out the whole edit it belongs to: all patches of
    that id, or of that id and ``seq`` where edits are numbered.  A NULL value
    clears the field.
    """
    edit = [key, "seq"] if "seq" in patches.columns else [key]
    amount, _ = parse_amount(F.col("value"))
    refused = refused_amounts(patches).select(*edit).distinct()
    legal = patches.where(F.col("field").isin(*DONATION_FIELDS)).join(refused, edit, "left_anti") \
        .withColumn("_amount", amount)
    order = F.col("seq") if "seq" in patches.columns else F.lit(0)
    fields = [f for f in DONATION_FIELDS if f in donations.columns]
    # The struct tells "set to NULL" from "not patched".
    wide = legal.groupBy(key).agg(*[
        F.max_by(F.struct("value", "_amount"), F.when(F.col("field") == f, order)).alias(f"_p_{f}")
        for f in fields])
    df = donations.join(wide, key, "left")
    for f in fields:
        new = F.col(f"_p_{f}._amount") if f == "amount" else F.col(f"_p_{f}.value")
        kind = donations.schema[f].dataType
        df = df.withColumn(f, F.when(F.col(f"_p_{f}").isNotNull(), new.try_cast(kind))
                           .otherwise(F.col(f)))
    return df.select(*donations.columns)


def refused_amounts(patches: DataFrame) -> DataFrame:
    _, fine = parse_amount(F.col("value"))
    return patches.where((F.col("field") == "amount") & ~fine)


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


NEWS_CONTENT = ("title", "url", "date", "content_text", "content_html", "scraped_at")


def upsert_news(base: DataFrame, batch: DataFrame, fields=NEWS_CONTENT) -> DataFrame:
    """Insert rows or overwrite the content fields by id; other columns survive.

    Of several rows with one id the highest ``seq`` counts, of equal ones the
    greatest content.
    """
    fields = [f for f in fields if f in base.columns and f in batch.columns]
    valid = batch.where(F.coalesce("id", F.lit(0)) != 0)
    order = F.col("seq") if "seq" in batch.columns else F.lit(0)
    new = valid.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct(order, *fields)).alias("_new"))
    joined = base.withColumn("_old", F.lit(True)).join(new, "id", "full_outer")
    return joined.select([
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in base.columns])


def upsert_report(base: DataFrame, batch: DataFrame) -> DataFrame:
    """imported / updated / skipped counts; rows without id are skipped.

    A new id that occurs more than once is imported once and then updated.
    """
    have = base.select("id").distinct().withColumn("_old", F.lit(True))
    per_id = batch.groupBy(F.coalesce("id", F.lit(0)).alias("id")).agg(F.count("*").alias("_n")).join(have, "id", "left")
    new = F.when(F.coalesce("_old", F.lit(False)), 0).otherwise(1)
    kinds = F.when(F.col("id") == 0, F.array(F.struct(F.lit("skipped").alias("outcome"), F.col("_n").alias("n")))).otherwise(
        F.array(F.struct(F.lit("imported").alias("outcome"), new.cast("long").alias("n")),
                F.struct(F.lit("updated").alias("outcome"), (F.col("_n") - new).alias("n"))))
    return (per_id.select(F.inline(kinds)).groupBy("outcome").agg(F.sum("n").alias("n")).where("n > 0"))


def replace_links(links: DataFrame, batch_links: DataFrame, batch: DataFrame) -> DataFrame:
    """Links of every news row in the batch are replaced, including by none."""
    ids = batch.select(F.col("id").alias("news_id"))
    return links.join(ids, "news_id", "left_anti").unionByName(batch_links)


def set_news_fields(news: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update by id.  ``hidden``: true, false or 'toggle' (as text);
    ``type`` outside the known kinds is ignored."""
    fields = [f for f in ("title", "content_text", "content_html", "admin_notes", "type", "hidden")
              if f in patches.columns]
    df = news.join(_keyed(patches, ["id"], fields), "id", "left")
    for f in fields:
        p = F.col(f"_p_{f}")
        if f == "hidden":
            now = F.coalesce(F.col("is_hidden").cast("boolean"), F.lit(False))
            new = F.when(p == "toggle", ~now).when(p.isNotNull(), p == "true")
            kind = news.schema["is_hidden"].dataType
            df = df.withColumn("is_hidden", F.coalesce(new.cast(kind), "is_hidden"))
        elif f == "type":
            df = df.withColumn("type", F.when(p.isin(*NEWS_TYPES), p).otherwise(F.col("type")))
        else:
            df = df.withColumn(f, F.coalesce(p, f))
    return df.select(*news.columns)


def set_news_types(news: DataFrame, html: str = "content_html") -> DataFrame:
    return news.withColumn("type", news_type(F.col(html)))


def insert_if_absent(docs: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the batch whose key is new, one per key, added to the table."""
    rest = [c for c in batch.columns if c != key]
    one = (batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
           .select(key, "_r.*").select(*batch.columns))
    return docs.unionByName(one.join(docs.select(key), key, "left_anti"))


def insert_report(docs: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    new = batch.select(key).distinct().join(docs.select(key), key, "left_anti").agg(F.count("*")).scalar()
    return (batch.agg(F.count("*").alias("_all")).withColumn("inserted", new)
            .withColumn("skipped", F.col("_all") - F.col("inserted")).drop("_all"))


def replace_items(old: DataFrame, batch: DataFrame, order: str, key=("package_id", "elms_id")) -> DataFrame:
    """Batch rows replace rows of the same key; of repeated ones the last stays."""
    rest = [c for c in batch.columns if c not in key]
    last = (batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(*key, "_r.*").select(*batch.columns))
    return old.join(last.select(*key), list(key), "left_anti").unionByName(last)


def mark_processed(packages: DataFrame, items: DataFrame, now: Column | None = None) -> DataFrame:
    """Item count and time stamp for every package that has items."""
    counts = items.groupBy(F.col("package_id").alias("id")).agg(F.count("*").alias("_n"))
    stamp = now if now is not None else F.current_timestamp()
    return (packages.join(counts, "id", "left")
            .withColumn("item_count", F.coalesce("_n", "item_count"))
            .withColumn("processed_at", F.when(F.col("_n").isNotNull(), stamp)
                        .otherwise(F.col("processed_at")))
            .select(*packages.columns))


def list_packages(packages: DataFrame) -> DataFrame:
    return packages.orderBy(F.col("meeting_date").desc(), F.col("id").desc())
