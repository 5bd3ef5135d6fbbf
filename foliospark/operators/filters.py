"""Access control and composable filters as Column predicates, semi and anti joins."""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCEPTED = ("auto_accepted", "user_confirmed", "user_corrected")
HUMAN = ("user_confirmed", "user_corrected")


OPEN_DEADLINES = ("open", "due_soon", "overdue", "needs_review")


def readable(docs: DataFrame, folders: DataFrame, user: int, household: int, role: str = "member") -> DataFrame:
    """Live documents of the household that the user may read: owners and admins all; members their own, and what the household
    shares, not highly sensitive, in a folder that is shared, theirs or granted to them."""
    rows = docs.filter(~F.col("deleted") & (F.col("household") == household))
    if role in ("owner", "admin"):
        return rows
    open_ = folders.filter(F.col("shared") | (F.col("folder_owner") == user) | F.array_contains("grants", F.lit(user).cast("long"))).select("folder").withColumn("_open", F.lit(True))
    shared = F.col("_open") & (F.col("acl_mode") == "household") & (F.col("sensitivity") != "highly_sensitive")
    return rows.join(open_, "folder", "left").filter((F.col("owner_id") == user) | F.coalesce(shared, F.lit(False))).drop("_open")


def writable(docs: DataFrame, user: int, role: str = "member") -> DataFrame:
    """Of readable documents those that the user may change: the owner's and, for owners and admins of the household, all."""
    return docs if role in ("owner", "admin") else docs.filter(F.col("owner_id") == user)


def writable_folders(folders: DataFrame, user: int) -> DataFrame:
    """Folders that the user may file into: shared, their own, or granted to them at a level that writes; a grant to read is not enough."""
    return folders.filter(F.col("shared") | (F.col("folder_owner") == user) | F.coalesce(F.array_contains("writers", F.lit(user).cast("long")), F.lit(False))).select("folder")


@dataclass(frozen=True)
class Related:
    """The tables beside the documents: tags (id, tag), members (id, folder), totals (id, total), edges (a, b, kind, status), deadlines (id, kind, status)."""

    tags: DataFrame | None = None
    members: DataFrame | None = None
    totals: DataFrame | None = None
    edges: DataFrame | None = None
    deadlines: DataFrame | None = None
    visible: DataFrame | None = None


@dataclass(frozen=True)
class Filters:
    families: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    sensitivities: tuple[str, ...] = ()
    review_statuses: tuple[str, ...] = ()
    reviewed_only: bool | None = None
    date_from: str | None = None
    date_to: str | None = None
    chars_min: int | None = None
    chars_max: int | None = None
    text: str | None = None
    tags: tuple[str, ...] = ()
    amount_min: Decimal | float | None = None
    amount_max: Decimal | float | None = None
    relationship_types: tuple[str, ...] = ()
    relationship_statuses: tuple[str, ...] = ()
    has_relationships: bool | None = None
    deadline_types: tuple[str, ...] = ()
    deadline_statuses: tuple[str, ...] = ()
    has_open_deadlines: bool | None = None
    primary_folder_only: bool = False

    def __post_init__(self):
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")
        if self.chars_min is not None and self.chars_max is not None and self.chars_min > self.chars_max:
            raise ValueError("chars_min is above chars_max")
        if self.amount_min is not None and self.amount_max is not None and self.amount_min > self.amount_max:
            raise ValueError("amount_min is above amount_max")

    def predicate(self, folders: bool = True) -> Column:
        """One conjunction; what is not set adds nothing.  Both values of reviewed_only admit auto_accepted.  folders: by the primary folder."""
        c: list[Column] = []
        for name, values in (("family", self.families), ("folder", self.folders if folders else ()), ("sensitivity", self.sensitivities), ("review_status", self.review_statuses)):
            if values:
                c.append(F.col(name).isin(*values))
        if self.reviewed_only is not None:
            c.append(F.col("review_status").isin(*ACCEPTED) if self.reviewed_only else ~F.col("review_status").isin(*HUMAN))
        if self.date_from:
            c.append(F.col("document_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            c.append(F.col("document_date") <= F.lit(self.date_to).cast("date"))
        if self.chars_min is not None:
            c.append(F.col("n_chars") >= self.chars_min)
        if self.chars_max is not None:
            c.append(F.col("n_chars") <= self.chars_max)
        if self.text:
            c.append(F.contains(F.lower("text"), F.lit(self.text.lower())))
        return reduce(Column.__and__, c, F.lit(True))

    def apply(self, docs: DataFrame, related: Related = Related()) -> DataFrame:  # noqa: B008
        """The documents that pass: the predicate, then semi and anti joins with the tables beside them."""
        bridged = bool(self.folders) and related.members is not None and not self.primary_folder_only
        out = docs.filter(self.predicate(folders=not bridged))
        if bridged:  # in the primary folder, or a member of one of them
            inside = related.members.filter(F.col("folder").isin(*self.folders)).select(F.col("id").alias("_member")).distinct()
            out = out.join(inside, F.col("id") == F.col("_member"), "left").filter(F.col("folder").isin(*self.folders) | F.col("_member").isNotNull()).drop("_member")
        if self.tags:
            out = out.join(_given(related.tags, "tags").filter(F.lower("tag").isin(*[t.lower() for t in self.tags])).select("id"), "id", "left_semi")
        if self.amount_min is not None or self.amount_max is not None:
            amount = F.lit(True)
            if self.amount_min is not None:
                amount = amount & (F.col("total") >= self.amount_min)
            if self.amount_max is not None:
                amount = amount & (F.col("total") <= self.amount_max)
            out = out.join(_given(related.totals, "totals").filter(amount).select("id"), "id", "left_semi")
        if self.relationship_types or self.relationship_statuses or self.has_relationships is not None:
            edges = _given(related.edges, "edges")
            wanted = F.col("status").isin(*self.relationship_statuses) if self.relationship_statuses else F.col("status") != "rejected"
            if self.relationship_types:
                wanted = wanted & F.col("kind").isin(*self.relationship_types)
            some = self.relationship_types or self.relationship_statuses or self.has_relationships
            both = edges.filter(wanted).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
            if related.visible is not None:  # the counterpart must be readable too
                both = both.join(related.visible.select(F.col("id").alias("other")), "other", "left_semi")
            out = out.join(both.select("id"), "id", "left_semi" if some else "left_anti")
        if self.deadline_types or self.deadline_statuses or self.has_open_deadlines is not None:
            wanted = F.col("status").isin(*(self.deadline_statuses or OPEN_DEADLINES))
            if self.deadline_types:
                wanted = wanted & F.col("kind").isin(*self.deadline_types)
            some = self.deadline_types or self.deadline_statuses or self.has_open_deadlines
            out = out.join(_given(related.deadlines, "deadlines").filter(wanted).select("id"), "id", "left_semi" if some else "left_anti")
        return out

    def intersect(self, other: Filters) -> Filters | None:
        """Both filters at once; None if no row can pass.  What can't be had in one filter is an error."""
        got = {}
        for name in ("families", "folders", "sensitivities", "review_statuses", "tags", "relationship_types", "relationship_statuses", "deadline_types", "deadline_statuses"):
            a, b = getattr(self, name), getattr(other, name)
            got[name] = tuple(x for x in a if x in b) if a and b else a or b
            if a and b and not got[name]:
                return None
        pick = lambda f, name: f([x for x in (getattr(self, name), getattr(other, name)) if x is not None], default=None)
        got |= {n: pick(max, n) for n in ("date_from", "chars_min", "amount_min")} | {n: pick(min, n) for n in ("date_to", "chars_max", "amount_max")}
        for name in ("has_relationships", "has_open_deadlines"):
            a, b = getattr(self, name), getattr(other, name)
            if a is not None and b is not None and a != b:
                return None
            got[name] = a if a is not None else b
        for name in ("text", "reviewed_only"):
            a, b = getattr(self, name), getattr(other, name)
            if a is not None and b is not None and a != b:
                raise ValueError(f"two values of {name} make no single filter")
            got[name] = a if a is not None else b
        got["primary_folder_only"] = self.primary_folder_only or other.primary_folder_only
        try:
            return Filters(**got)
        except ValueError:
            return None


def _given(df: DataFrame | None, name: str) -> DataFrame:
    if df is None:
        raise ValueError(f"the filter needs the table {name}")
    return df


def facets(docs: DataFrame, related: Related, top: int = 20) -> DataFrame:
    """(facet, value, total): the eight facets of the filtered documents, each value with its number of documents; months newest first, 24 of
    them, others by number, `top` of each.  Bridges count a document once; a relationship counts only if its other document is in
    `related.visible`, where that is given."""
    ids = docs.select("id")
    own = docs.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("families", "folders", "reviewStatus", "sensitivity", "months"))), F.array("family", "folder", "review_status", "sensitivity", F.date_format("document_date", "yyyy-MM")))).alias("facet", "value"), "id")
    bridge = lambda name, df, value: df.join(ids, "id", "left_semi").select(F.lit(name).alias("facet"), value.alias("value"), "id").distinct()
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    edges = _given(related.edges, "edges").filter("status <> 'rejected'").select("kind", F.explode(ends).alias("e")).select("kind", "e.*")
    if related.visible is not None:
        edges = edges.join(related.visible.select(F.col("id").alias("other")), "other", "left_semi")
    open_ = _given(related.deadlines, "deadlines").filter(F.col("status").isin(*OPEN_DEADLINES))
    rows = own.unionByName(bridge("tags", _given(related.tags, "tags"), F.col("tag"))).unionByName(bridge("relationshipTypes", edges, F.col("kind"))).unionByName(bridge("deadlineTypes", open_, F.col("kind")))
    counted = rows.filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("total"))
    month = F.col("facet") == "months"
    order = [F.when(month, F.col("value")).desc_nulls_last(), F.desc("total"), F.lower("value"), F.col("value")]
    ranked = counted.withColumn("_n", F.row_number().over(Window.partitionBy("facet").orderBy(*order)))
    return ranked.filter(F.col("_n") <= F.when(month, 24).otherwise(top)).drop("_n")


def facet(docs: DataFrame, value: Column, top: int = 20) -> DataFrame:
    return docs.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "value").limit(top)


def page_with_count(docs: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """A page, and how many rows there are in all."""
    return page_of(docs, offset, limit), docs.count()


def page_of(docs: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page in the order of date, newest first, then id."""
    return docs.orderBy(F.col("document_date").desc_nulls_last(), "id").offset(offset).limit(limit)
