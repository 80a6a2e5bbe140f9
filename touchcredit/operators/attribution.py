"""Attach orders to campaigns.

One customer may hold a large share of all orders or of all touches, so no operator here brings a whole
large customer into one task: lists are reduced to distinct members before they are joined, and the as-of
lookup works in fixed slices of time.

Customer keys are expected in lower case on both sides; readers and `enrich_orders` see to that once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import minute_number

SLICE_SECONDS = 3600  # a large customer's orders and touches of so long a time are sorted by one task
#: Customers are counted in so many buckets by hash; those of a bucket with more rows than this are large.
BUCKETS, LARGE = 1 << 16, 1 << 17


def list_members(touches: DataFrame, keep_fanout: bool = False) -> DataFrame:
    """One row per campaign and recipient; with ``keep_fanout`` also ``copies``, the rows it had."""
    pairs = touches.select("campaign", "recipient")
    if keep_fanout:
        return pairs.groupBy("campaign", "recipient").agg(F.count(F.lit(1)).alias("copies"))
    return pairs.distinct()


def by_list(
    orders: DataFrame, touches: DataFrame, null_safe: bool = False, keep_fanout: bool = False
) -> DataFrame:
    """Label each order with every campaign whose list holds its customer, as ``recent_open``.

    An order on two lists gives two rows. A recipient listed twice in one list counts once; with
    ``keep_fanout`` the number of listings is kept as the weight ``copies`` for :func:`weigh_copies`, so the
    repeated rows themselves are never produced. With ``null_safe`` a null
    customer matches a null recipient.

    For metrics alone, label cells in place of orders (``order_cells`` first, ``by_list`` after it): a
    customer then has a bounded number of rows in this join.
    """
    members = list_members(touches, keep_fanout)
    email, recipient = orders["customer_email"], members["recipient"]
    same = email.eqNullSafe(recipient) if null_safe else email == recipient
    return (
        orders.join(members, same)
        .drop("recipient")
        .withColumnRenamed("campaign", "recent_open")
    )


def by_click(
    orders: DataFrame, touches: DataFrame, null_safe: bool = False, keep_fanout: bool = False
) -> DataFrame:
    """As :func:`by_list`, for recipients who clicked."""
    return by_list(orders, touches.where("clicked"), null_safe, keep_fanout)


def list_weights(touches: DataFrame, keep_fanout: bool = False) -> DataFrame:
    """Per recipient: on how many lists (``opened``), and on how many with a click (``clicks``).

    Joined to orders this weighs all sources in one pass, where by_list and by_click need one join each.
    """
    rows = touches.where("recipient IS NOT NULL").select(
        "campaign", "recipient", F.coalesce("clicked", F.lit(False)).alias("clicked")
    )
    per_list = rows.groupBy("campaign", "recipient").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("clicked").alias("click_rows")
    )
    if not keep_fanout:
        per_list = per_list.withColumns(
            {"rows": F.least("rows", F.lit(1)), "click_rows": F.least("click_rows", F.lit(1))}
        )
    return per_list.groupBy("recipient").agg(
        F.sum("rows").alias("opened"), F.sum("click_rows").alias("clicks")
    )


def touch_matrix(orders: DataFrame, touches: DataFrame, names: Sequence[str]) -> DataFrame:
    """Orders with one column per campaign holding the latest ``sent_at`` of that list.

    The touches are pivoted per recipient before the join, so the orders are shuffled once however many
    campaigns there are, and not at all multiplied. For display; attribution reads the long touches.
    """
    wide = (
        touches.where("recipient IS NOT NULL")
        .groupBy("recipient")
        .pivot("campaign", list(names))
        .agg(F.max("sent_at"))
    )
    return orders.join(wide, orders["customer_email"] == wide["recipient"], "left").drop("recipient")


def weigh_copies(labelled: DataFrame) -> DataFrame:
    """Turn ``copies`` of a label kept with ``keep_fanout`` into number of orders and revenue of each row.

    Takes orders or cells and gives cells.
    """
    n = F.col("orders") if "orders" in labelled.columns else F.lit(1)
    copies = F.col("copies")
    return labelled.withColumns(
        {"orders": n * copies, "billing_amount": F.col("billing_amount") * copies}
    ).drop("copies")


def in_window(
    orders: DataFrame, start: Column, days: int = C.WINDOW_DAYS, scope: Column | None = None
) -> DataFrame:
    """Orders in ``scope`` created in ``[start, start + days]``; both ends belong to the window.

    Reaches the scan when ``start`` is a literal.
    """
    end = start + F.make_dt_interval(F.lit(days))
    inside = orders if scope is None else orders.where(scope)
    return inside.where((F.col("created_date") >= start) & (F.col("created_date") <= end))


def by_window(
    orders: DataFrame,
    touches: DataFrame,
    start: Column,
    days: int = C.WINDOW_DAYS,
    scope: Column | None = None,
    null_safe: bool = False,
    keep_fanout: bool = False,
) -> DataFrame:
    """Orders of :func:`in_window` by customers on the list."""
    return by_list(in_window(orders, start, days, scope), touches, null_safe, keep_fanout)


def _slice(ts: Column, seconds: int) -> Column:
    """The number of the slice of time that holds ``ts``."""
    return F.floor(minute_number(ts) * 60 / seconds)


def _eligible_types(eligible: DataFrame) -> tuple[Column, Column]:
    """What the index says of campaigns and order types, and all tracked types, as two values.

    Campaigns that are eligible for the same types are one *class*: the latest touch of a class is the same for all its
    types, so a touch is one row however many types it is eligible for, and an order looks into the few classes of its
    type. Of touches at one time the greatest *rank* wins: the first place in the index, then the last name. Fields of
    the first value: ``ranks`` (campaign to its ranks, one for each place it has), ``classes`` (type to its classes),
    ``class_of`` and ``names`` (a rank's class and campaign).

    The index has a row for each mailed campaign, so both are read as scalar subqueries: no order or touch is
    ever placed by its campaign or type, of which there are few.
    """
    place = F.min("pos").cast("long").alias("pos")
    per_type = eligible.where("eligible = 1 AND order_type IS NOT NULL").groupBy("campaign", "order_type").agg(place)
    types = per_type.groupBy("campaign").agg(F.collect_list(F.struct("order_type", "pos")).alias("types"))
    at_places = F.expr(
        "transform(array_distinct(types.pos), p -> struct(-p AS place, campaign AS campaign,"
        " array_sort(filter(types, t -> t.pos <=> p).order_type) AS of))"
    )
    ranked = F.array_sort(F.flatten(F.collect_list(at_places)))
    index = types.agg(ranked.alias("ranked"), F.collect_set("campaign").alias("campaigns")).withColumn(
        "sets", F.expr("array_distinct(ranked.of)")
    )
    as_value = index.selectExpr(
        """struct(
          map_from_entries(transform(campaigns, c -> struct(c, transform(filter(transform(ranked, (r, i) -> struct(r.campaign AS campaign, i + 1 AS rank)), r -> r.campaign = c), r -> r.rank)))) AS ranks,
          map_from_entries(transform(array_distinct(flatten(sets)), t -> struct(t, transform(filter(transform(sets, (s, i) -> struct(s AS of, i + 1 AS class)), s -> array_contains(s.of, t)), s -> s.class)))) AS classes,
          transform(ranked, r -> cast(array_position(sets, r.of) AS int)) AS class_of,
          ranked.campaign AS names)"""
    )
    return as_value.scalar(), eligible.agg(F.collect_set("order_type")).scalar()


def _bucket(place: Column) -> Column:
    return F.pmod(place, F.lit(BUCKETS)).cast("int")


def _crowded(customers: Sequence[DataFrame], large: int) -> Column:
    """Whether each bucket holds more than ``large`` of the rows of all ``customers``, as one array.

    Each frame is counted by itself and only the counts are put together: in one stage with a larger frame, adaptive
    execution leaves a smaller one a task or two, however much it holds there.
    """
    bucket = _bucket(F.xxhash64("__customer")).alias("bucket")
    counts = reduce(DataFrame.union, [c.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")) for c in customers])
    found = counts.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > large).agg(F.collect_set("bucket").alias("found"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.array_contains("found", b))
    return found.select(every).scalar()


def latest_touch(
    orders: DataFrame,
    touches: DataFrame,
    eligible: DataFrame,
    complete: bool = False,
    slice_seconds: int = SLICE_SECONDS,
    keep_fanout: bool = False,
    large: int = LARGE,
) -> DataFrame:
    """Credit each order to the latest touch strictly before it, as ``recent_open``.

    Only campaigns marked eligible for the order's type count; of two touches at one time the campaign
    first in the index wins, and of two with one place the last by name. The result holds the credited
    orders. With ``complete`` it holds every order whose customer has any touch at all, with three outcomes:
    a campaign, ``none_open`` (a tracked type without an earlier eligible touch), null (a type the index does
    not track). With ``keep_fanout`` the rows that the credited touch had (one recipient listed several times
    at one time) are kept as the weight ``copies``; the repeated rows are never produced.

    Orders and touches are first counted in buckets of customers. A customer of a bucket with at most ``large`` rows is
    sorted whole; the time of others is cut into slices, so a task is bounded by that number and by the clock:

    1. inside a slice (or a whole customer), a running window gives the last touch before every order;
    2. of the customers cut into slices, the last touch of each slice and campaign, found where the touches already are,
       is carried over the slices by a second window, up to the first order of each slice.

    What the windows sort are narrow rows, one for a touch however many types it is eligible for. The orders themselves
    meet only what was found for their customer, time and type.
    """
    index, tracked = _eligible_types(eligible)
    # Touches and asked times are dealt out by all they hold, so that one shuffle of each serves the counts and the lookup.
    each = F.explode_outer if complete else F.explode
    sent = (
        touches.where("sent_at IS NOT NULL AND recipient IS NOT NULL")
        .select(
            F.col("recipient").alias("__customer"), F.col("sent_at").alias("__ts"),
            each(F.element_at(index["ranks"], F.col("campaign"))).alias("__rank"),
        )
        .repartition("__customer", "__ts", "__rank")
    )
    copies = ["__copies"] if keep_fanout else []
    columns = orders.columns
    inside = orders.where("customer_email IS NOT NULL AND created_date IS NOT NULL")
    is_tracked = F.coalesce(F.array_contains(tracked, F.col("order_type")), F.lit(False))
    times = inside.where(is_tracked).select(
        F.col("customer_email").alias("__customer"), F.col("created_date").alias("__ts"), "order_type",
        F.explode(F.element_at(index["classes"], F.col("order_type"))).alias("__class"),
    ).distinct()
    crowded = _crowded([sent, times], large)
    if complete:
        touched = sent.select(F.col("__customer").alias("__touched")).distinct()
        inside = inside.join(touched, F.col("customer_email") == F.col("__touched"), "left_semi")
    else:
        inside = inside.where(is_tracked)
    if keep_fanout:
        sent = sent.groupBy("__customer", "__ts", "__rank").agg(F.count(F.lit(1)).alias("__copies"))

    slot = ["__customer", "__slice"]
    # A hash goes first in what is sorted: keys of text often begin alike, and a number is compared at once. It is worked out
    # after the shuffle, where it would be as large as all that the touch holds.
    place = F.xxhash64("__customer").alias("__place")

    def placed(rows: DataFrame) -> DataFrame:
        # A customer that is sorted whole has no slices.
        cut = F.when(F.get(crowded, _bucket(F.xxhash64("__customer"))), _slice(F.col("__ts"), slice_seconds))
        return rows.withColumn("__slice", cut).repartition(*slot)

    def in_slices(rows: DataFrame) -> DataFrame:
        # Behind a generator the condition stays above the shuffle, which both lookups read.
        return rows.select(F.inline(F.array(F.struct(*rows.columns)))).where("__slice IS NOT NULL")

    marks, asked = placed(sent), placed(times)
    of_class = F.element_at(index["class_of"], F.col("__rank")).alias("__class")

    def looked_up(touched: DataFrame, asking: DataFrame, keys: list[str]) -> DataFrame:
        # At equal times an order, which has no touch, comes before the touches: a touch must be strictly earlier.
        key = Window.partitionBy("__sorted", "__class", *keys).orderBy("__ts", "__rank")
        so_far = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = touched.select(*slot, "__ts", "__rank", *copies, of_class).unionByName(asking, allowMissingColumns=True)
        # Plain columns are carried, and made a value for the orders alone: rank and copies are set wherever there is a touch.
        touch = {"__ts": F.when(F.col("__rank").isNotNull(), F.col("__ts")), **{c: F.col(c) for c in ("__rank", *copies)}}
        last = {f"__last{c}": F.last(value, ignorenulls=True).over(so_far) for c, value in touch.items()}
        rows = both.withColumn("__sorted", F.xxhash64("__class", *keys)).withColumns(last).where("order_type IS NOT NULL")
        found = F.struct(*[F.col(f"__last{c}").alias(c) for c in touch])
        return rows.withColumn("__found", F.when(F.col("__last__rank").isNotNull(), found))

    near = (
        looked_up(marks, asked, slot)
        .groupBy(place, *slot, "order_type", "__ts")
        .agg(F.max("__found").alias("__near"))
    )
    latest = [F.max("__ts").alias("__ts"), *(F.max_by(c, "__ts").alias(c) for c in copies)]
    first = in_slices(asked).groupBy(*slot, "order_type", "__class").agg(F.min("__ts").alias("__ts"))
    far = (
        looked_up(in_slices(marks).groupBy(*slot, "__rank").agg(*latest), first, ["__customer"])
        .where("__found IS NOT NULL")
        .repartition(*slot)
        .groupBy(*slot)
        .agg(F.collect_list(F.struct("order_type", "__found")).alias("__far"))
    )
    own = F.filter("__far", lambda f: f["order_type"] == F.col("order_type"))["__found"]
    credit = near.join(far, slot, "left").select(
        "__customer", "__ts", F.col("order_type").alias("__type"), F.coalesce("__near", F.array_max(own)).alias("__found")
    )
    same = (
        (F.col("customer_email") == F.col("__customer"))
        & (F.col("created_date") == F.col("__ts"))
        & (F.col("order_type") == F.col("__type"))
    )
    found = inside.join(credit.where("__found IS NOT NULL"), same, "left" if complete else "inner")
    label = F.element_at(index["names"], F.col("__found.__rank"))
    if complete:
        label = F.when(is_tracked, F.coalesce(label, F.lit(C.NONE_OPEN)))
    weight = [F.coalesce("__found.__copies", F.lit(1).cast("long")).alias("copies")] if keep_fanout else []
    return found.select(*columns, label.alias("recent_open"), *weight)


def credited(labelled: DataFrame) -> DataFrame:
    """Drop orders without an earlier touch and orders of untracked types from a complete labelling."""
    return labelled.where(F.col("recent_open").isNotNull() & (F.col("recent_open") != C.NONE_OPEN))
