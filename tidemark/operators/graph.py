"""Account-graph operators over a transaction table (id, sender_account_id, receiver_account_id, ...). A self transfer counts as an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.reach import within_two_steps
from tidemark.operators.tables import kept


def internal(txn: DataFrame) -> DataFrame:
    """Transactions between two accounts."""
    return txn.where("sender_account_id is not null and receiver_account_id is not null")


def edges(txn: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return internal(txn).select(F.col("sender_account_id").alias("src"), F.col("receiver_account_id").alias("dst")).distinct()


def fan_in(txn: DataFrame, least: int = 5) -> DataFrame:
    """(account_id, unique_senders) for accounts that at least so many distinct accounts pay."""
    return edges(txn).groupBy(F.col("dst").alias("account_id")).agg(F.count("*").alias("unique_senders")).where(F.col("unique_senders") >= least)


def round_trips(txn: DataFrame) -> DataFrame:
    """(account_id, partner_id, round_trip_count): pairs of one transaction there and one back, in any order. Pairs are counted by product, never listed."""
    n = internal(txn).groupBy(F.col("sender_account_id").alias("a"), F.col("receiver_account_id").alias("b")).agg(F.count("*").alias("n"))
    back = n.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    return n.join(back, ["a", "b"]).select(F.col("a").alias("account_id"), F.col("b").alias("partner_id"), (F.col("n") * F.col("m")).alias("round_trip_count"))


def round_trips_since(txn: DataFrame, hours: int = 48) -> DataFrame:
    """(id, round_trip_count) by transaction: pairs of its sender's transactions out and back, both at most `hours` before it or later."""
    legs = internal(txn).select("sender_account_id", "receiver_account_id", "ts")
    there = legs.select(F.col("sender_account_id").alias("a"), F.col("receiver_account_id").alias("b"), F.col("ts").alias("t1"))
    back = legs.select(F.col("sender_account_id").alias("b"), F.col("receiver_account_id").alias("a"), F.col("ts").alias("t2"))
    pairs = there.join(back, ["a", "b"]).groupBy("a", F.least("t1", "t2").alias("first")).agg(F.count("*").alias("n"))
    # pairs and transactions of a sender in one order of time: a window counts the pairs, no transaction meets each pair
    rows = pairs.select("a", F.col("first").alias("at"), "n", F.lit(None).cast(txn.schema["id"].dataType).alias("id")).unionByName(txn.select(F.col("sender_account_id").alias("a"), F.col("ts").alias("at"), F.lit(0).cast("long").alias("n"), "id"))
    found = F.expr(f"sum(n) over (partition by a order by at range between interval '{hours}' hour preceding and unbounded following)")
    return rows.withColumn("round_trip_count", found).where("id is not null").select("id", F.coalesce("round_trip_count", F.lit(0).cast("long")).alias("round_trip_count"))


def incidence(txn: DataFrame) -> DataFrame:
    """(account, txn, other): each end of each internal transaction; a self transfer has one."""
    t = internal(txn)
    one = t.select(F.col("sender_account_id").alias("account"), F.col("id").alias("txn"), F.col("receiver_account_id").alias("other"))
    two = t.where("sender_account_id <> receiver_account_id").select(F.col("receiver_account_id").alias("account"), F.col("id").alias("txn"), F.col("sender_account_id").alias("other"))
    return one.unionByName(two)


def network_hops(account: DataFrame, txn: DataFrame) -> DataFrame:
    """(account_id, max_hops): length of the longest undirected path of up to 5 steps to an account: 4, 2, or 1 where there is none.

    Paths between accounts go over transactions and have even length; 4 needs a neighbour with another transaction.
    """
    ends = incidence(txn)
    degree = ends.groupBy("account").agg(F.count("*").alias("degree"))
    reach = ends.join(degree.select(F.col("account").alias("other"), "degree"), "other")
    by = reach.groupBy("account").agg(F.max("degree").alias("most"))
    hops = F.when(F.col("most") >= 2, 4).when(F.col("most") >= 1, 2).otherwise(1)
    return account.select(F.col("id").alias("account")).join(by, "account", "left").select(F.col("account").alias("account_id"), hops.alias("max_hops"))


def connected_accounts(account: DataFrame, txn: DataFrame) -> DataFrame:
    """(account_id, connected_accounts): distinct accounts that paths over one or two transactions reach, itself included if one returns."""
    near = kept(incidence(txn).groupBy("account", "other").agg(F.count("*").alias("n")), "links")
    # links lead both ways, so an account is always next to one next to it; but a way there and back needs two transactions
    back = near.groupBy("account").agg(F.max((F.col("n") > 1) | (F.col("other") == F.col("account"))).alias("back"))
    n = within_two_steps(near).join(back, "account").select("account", (F.col("n") - F.when(F.col("back"), 0).otherwise(1)).alias("n"))
    return account.select(F.col("id").alias("account")).join(n, "account", "left").select(F.col("account").alias("account_id"), F.coalesce("n", F.lit(0).cast("long")).alias("connected_accounts"))


def shared_devices(txn: DataFrame, account: DataFrame) -> DataFrame:
    """(id, device_users): distinct customers with a transaction on the transaction's device, 1 without a device."""
    owner = account.select(F.col("id").alias("sender_account_id"), "customer_id")
    users = txn.where("device_id is not null").select("device_id", "sender_account_id").distinct().join(owner, "sender_account_id")
    users = users.groupBy("device_id").agg(F.countDistinct("customer_id").alias("n"))
    return txn.select("id", "device_id").join(users, "device_id", "left").select("id", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("device_users"))


#: Customers of one cell, about: those who used the same devices go together.
CELL = 256


def device_uses(txn: DataFrame, account: DataFrame) -> DataFrame:
    """Distinct (device_id, customer_id)."""
    owner = account.select(F.col("id").alias("sender_account_id"), "customer_id")
    uses = txn.where("device_id is not null").select("device_id", "sender_account_id").distinct().join(owner, "sender_account_id")
    return uses.where("customer_id is not null").select("device_id", "customer_id").distinct()


def device_cells(uses: DataFrame) -> DataFrame:
    """(devices, customers): customers who used the very same devices, about CELL in a row; each is in one row."""
    sets = uses.groupBy("customer_id").agg(F.array_sort(F.collect_list("device_id")).alias("devices"))
    parts = sets.groupBy("devices").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    part = F.pmod(F.xxhash64("customer_id"), F.col("parts"))
    return sets.join(parts, "devices").groupBy("devices", part.alias("part")).agg(F.collect_list("customer_id").alias("customers")).drop("part")


def device_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right (devices, ...) as structs `a` and `b`, with the devices both used: a row for each pair that has any.

    Pairs meet at each device they share and are kept at the first, so they need no grouping.
    """
    at = lambda df, name: df.select(F.explode("devices").alias("device_id"), F.struct(*df.columns).alias(name))
    met = at(left, "a").join(at(right, "b"), "device_id").withColumn("devices", F.array_intersect("a.devices", "b.devices"))
    return met.where(F.col("devices")[0] == F.col("device_id")).select("a", "b", "devices")


def shared_device_network(txn: DataFrame, account: DataFrame, customer_id: int | None = None, shown=lambda devices: devices) -> DataFrame:
    """(customer_id, other_id, devices): pairs of customers who used one device, with the devices as `shown` has them; of one customer or all.

    Customers with the same devices are paired as a whole; single pairs are listed last, so none is shuffled or written.
    """
    uses = device_uses(txn, account)
    mine = uses if customer_id is None else uses.where(F.col("customer_id") == customer_id)
    links = device_links(device_cells(mine), device_cells(uses)).select(F.col("a.customers").alias("customers"), F.col("b.customers").alias("others"), shown(F.col("devices")).alias("devices"))
    pairs = links.select(F.explode("customers").alias("customer_id"), "others", "devices").select("customer_id", F.explode("others").alias("other_id"), "devices")
    return pairs.where("customer_id <> other_id")


def closest_by_device(txn: DataFrame, account: DataFrame, most: int = 15) -> DataFrame:
    """(customer_id, other_id, devices): of shared_device_network(), each customer's `most` others with the most devices, equal ones by id.

    Found for all customers with the same devices at once: they have the same others but for themselves, so one more is taken. Of cells in a link,
    those are looked at that no `most` others go before by their number of devices.
    """
    cells = device_cells(device_uses(txn, account))
    few = cells.select("devices", F.size("customers").alias("n"), F.slice(F.array_sort("customers"), 1, most + 1).alias("customers"))
    sets = few.groupBy("devices").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("customers"))), 1, most + 1).alias("customers"))
    sizes = sets.select("devices", "n")
    links = device_links(sizes, sizes).select(F.col("a.devices").alias("own"), F.col("b.devices").alias("devices"), F.col("b.n").alias("n"), F.col("devices").alias("shared"))
    level = Window.partitionBy("own").orderBy("size")
    before = links.groupBy("own", (-F.size("shared")).alias("size")).agg(F.sum("n").alias("n"))
    before = before.withColumn("before", F.sum("n").over(level) - F.col("n")).where(F.col("before") <= most).select("own", "size")
    near = links.withColumn("size", -F.size("shared")).join(before, ["own", "size"]).join(sets.select("devices", "customers"), "devices")
    one = near.select("own", F.explode("customers").alias("other_id"), "size", "shared")
    first = one.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy("size", "other_id"))).where(F.col("place") <= most + 1)
    others = first.groupBy(F.col("own").alias("devices")).agg(F.array_sort(F.collect_list(F.struct("place", "other_id", "shared"))).alias("others"))
    own = cells.select("devices", F.explode("customers").alias("customer_id")).join(others, "devices")
    kept = F.slice(F.filter("others", lambda x: x["other_id"] != F.col("customer_id")), 1, most)
    return own.select("customer_id", F.explode(kept).alias("x")).select("customer_id", "x.other_id", F.col("x.shared").alias("devices"))


def network_connections(txn: DataFrame, account: DataFrame, customer_id: int | None = None) -> DataFrame:
    """(customer_id, other_id, kind): customers who share a device or were paid, without repeats."""
    shared = shared_device_network(txn, account, customer_id, lambda _: F.lit("SHARED_DEVICE")).withColumnRenamed("devices", "kind")
    owner = account.select("id", "customer_id")
    paid = edges(txn).join(owner.select(F.col("id").alias("src"), "customer_id"), "src").join(owner.select(F.col("id").alias("dst"), F.col("customer_id").alias("other_id")), "dst")
    paid = paid if customer_id is None else paid.where(F.col("customer_id") == customer_id)
    paid = paid.where("customer_id <> other_id").select("customer_id", "other_id", F.lit("COUNTERPARTY").alias("kind"))
    return shared.unionByName(paid.distinct())  # pairs with a device come once


def induced_subgraph(nodes: DataFrame, txn: DataFrame) -> DataFrame:
    """(src, dst, weight): edges between nodes (account_id), without self loops, in both directions, repeats summed."""
    keep = nodes.select("account_id").distinct()
    e = edges(txn).where("src <> dst").join(keep.withColumnRenamed("account_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("account_id", "dst"), "dst", "left_semi")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def neighbour_mean(nodes: DataFrame, graph: DataFrame, columns: list[str]) -> DataFrame:
    """nodes (account_id, columns...): the weighted mean of each column over the neighbours in graph (src, dst, weight), 0 without any."""
    h = graph.join(nodes.select(F.col("account_id").alias("dst"), *columns), "dst")
    mean = h.groupBy(F.col("src").alias("account_id")).agg(*((F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"nb_{c}") for c in columns))
    return nodes.select("account_id").join(mean, "account_id", "left").select("account_id", *(F.coalesce(f"nb_{c}", F.lit(0.0)).alias(f"nb_{c}") for c in columns))
