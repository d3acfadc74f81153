"""Point-in-time features: window counts as they were known, from persistent segment trees.

Every sale asks at a time ``t`` about its client's events of the last days, and
may see only what was known by then.  An event counts in a window of d days if its
time lies in (t - d, t] and it was known at t; taking it as known no earlier than
it happened makes the upper bound hold by itself.

Shards.  Rows go to cells.  Clients of few rows share cells by hash.  A client of
more than BIG rows is cut into slices of the longest window: a sale lies in the
slice of its t, an event in each slice whose sales may see it (two, a sale three
for its label).  If a slice holds more than CELL rows, its events are dealt to as
many salts as that takes (lines by item, so that distinct items add up), its sales
to each, and the salts' sums are added.  Before that, lines of equal sale, item and
shipping time have become one row, so that no single key can fill a cell.

Trees.  A cell's events, all clients one after the other, are numbered by event
time; in order of the time when they became known they are inserted into a
segment tree over these numbers.  The tree is persistent: an insertion copies the
nodes on its path and nothing else, so each event count is a version.  The copies
of a level lie in one array: a node's next to each other, in order of versions,
with the sums up to each and, as child pointer, how many insertions went left.
A window query takes the version known at t and descends once, for all sales of
the cell together.  Items: the latest known occurrence of each item is a point;
when a later one becomes known, the point moves, so that the sum of the points in
a window is the number of distinct items.

Defined results: times are UTC; sales without client or time return no rows, one
without an id is asked about at an offset of the empty text's CRC; events without
time, client or arrival, and lines without shipping time, are never known (such
sales still count for labels); null, NaN and infinite amounts are 0; repeated sales
count each and return a row each, also joining the lines of their id each; clicks
equal in all columns are one; ties in click times go to the larger id (null least);
empty tables give an empty result; other columns only matter to the equality of
clicks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import table, written

WINDOWS = (2, 14)
LABEL_DAYS = 7
#: Minutes after arrival at which a row is known.
DELAY = 240
#: Seconds over which the times of asking are spread.
SPREAD = 259_200
DAY = 86_400_000_000
#: Rows of a client from which it is cut into slices, and rows of a cell.
BIG = 8192
CELL = 1 << 17
#: Rows of a cell of small clients, on average.
SHARED = 1 << 15
CLICK, SALE, LINE, QUERY = range(4)
_COLUMNS = ("kind", "client", "at", "known", "id", "n", "more", "cents")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without a zone (then: UTC)."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        past = F.col(name) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        return (past.cast("interval second").cast("decimal(24, 6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp"))


def cents(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(100 * x + F.lit(0.5))).otherwise(0).cast("long")


def events(clicks: DataFrame, sales: DataFrame, lines: DataFrame, delay: int = DELAY) -> DataFrame:
    """All events and all sales that ask, as kind, client, at, known, id, n, more, cents."""
    known = lambda arrived, *since: F.when(arrived.isNotNull(), F.greatest(arrived + delay * 60_000_000, *since))
    whole = lambda x: F.lit(x).cast("long")
    clicks = clicks.distinct()
    clicked = clicks.select(F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("at"), micros(clicks, "arrived_at").alias("arrived"), F.col("click_id").cast("long").alias("id"), F.coalesce((F.col("kind") == "purchase").cast("long"), whole(0)).alias("more"), cents("value").alias("cents"))
    clicked = clicked.select(F.lit(CLICK).alias("kind"), "client", "at", known(F.col("arrived"), F.col("at")).alias("known"), "id", whole(1).alias("n"), "more", "cents")
    offset = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % SPREAD * 1_000_000
    sold = sales.select(F.col("sale_id").cast("long").alias("sale"), F.col("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("at"), micros(sales, "arrived_at").alias("arrived"), cents("total").alias("cents"), offset.alias("offset")).where("client IS NOT NULL AND at IS NOT NULL")
    made = sold.select(F.lit(SALE).alias("kind"), "client", "at", known(F.col("arrived"), F.col("at")).alias("known"), whole(None).alias("id"), whole(1).alias("n"), whole(0).alias("more"), "cents")
    asked = sold.select(F.lit(QUERY).alias("kind"), "client", (F.col("at") + F.col("offset")).alias("at"), whole(None).alias("known"), F.col("sale").alias("id"), whole(1).alias("n"), F.monotonically_increasing_id().alias("more"), whole(0).alias("cents"))
    shipped = lines.select(F.col("sale_id").cast("long").alias("sale"), F.col("item_id").cast("long").alias("id"), micros(lines, "shipped_at").alias("shipped"), cents("amount").alias("cents")).where("sale IS NOT NULL AND shipped IS NOT NULL")
    shipped = shipped.groupBy("sale", "id", "shipped").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("line_cents"))
    lined = shipped.join(sold.where("arrived IS NOT NULL").select("sale", "client", "at", "arrived").hint("merge"), "sale")
    lined = lined.select(F.lit(LINE).alias("kind"), "client", "at", known(F.col("arrived"), F.col("at"), F.col("shipped")).alias("known"), "id", "n", whole(0).alias("more"), F.col("line_cents").alias("cents"))
    seen = clicked.unionByName(lined).where("client IS NOT NULL AND at IS NOT NULL AND known IS NOT NULL")
    return seen.unionByName(made).unionByName(asked)


def cells(rows: DataFrame, windows: tuple[int, ...], label_days: int) -> DataFrame:
    """``rows`` dealt to cells: group, slice, salt, salts."""
    span = max(windows) * DAY
    slice_of = lambda c: F.floor(c / F.lit(float(span))).cast("long")
    counts = rows.groupBy("client", slice_of(F.col("at")).alias("slice")).agg(F.count(F.lit(1)).alias("m"))
    clients = written(counts.groupBy("client").agg(F.sum("m").alias("m"), F.max("m").alias("peak")), "time-clients")
    # a slice's cell holds the events of the slices before and after it, too
    plan = clients.where(F.col("m") > BIG).select("client", F.ceil(3 * F.col("peak") / CELL).cast("int").alias("salts"))
    shared = max(1, (clients.where(F.col("m") <= BIG).agg(F.sum("m")).first()[0] or 0) // SHARED)
    dealt = rows.join(plan.hint("merge"), "client", "left")
    small, at, kind = F.col("salts").isNull(), F.col("at"), F.col("kind")
    first = slice_of(F.when(kind == SALE, at - label_days * DAY).otherwise(at))
    last = slice_of(F.when(kind == QUERY, at).otherwise(at + span - 1))
    dealt = dealt.withColumn("slice", F.explode(F.when(small, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(first, last))))
    hashed = F.when((kind == LINE) & F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("kind", "at", "known", "id", "cents"))
    own = F.array(F.pmod(hashed, F.col("salts").cast("long")).cast("int"))
    salts = F.when(small | (F.col("salts") == 1), F.array(F.lit(0))).when(kind == QUERY, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)
    group = F.when(small, F.pmod(F.xxhash64("client"), F.lit(shared))).otherwise(F.col("client"))
    return dealt.withColumn("salt", F.explode(salts)).select(*_COLUMNS, group.alias("group"), "slice", "salt", (F.coalesce(F.col("salts"), F.lit(1)) > 1).alias("part"))


class PersistentTree:
    """Sums over event numbers, in every version; ``numbers`` and ``values`` are in order of insertion."""

    def __init__(self, numbers: np.ndarray, values: list[np.ndarray]):
        self.size, self.levels = len(numbers), []
        for bit in reversed(range(max(1, (self.size - 1).bit_length()))):
            left = numbers >> bit & 1 == 0
            went_left = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
            order = np.concatenate((np.flatnonzero(left), np.flatnonzero(~left)))
            numbers, values = numbers[order], [v[order] for v in values]
            self.levels.append((bit, went_left, [np.concatenate(([0], np.cumsum(v))) for v in values]))

    def since(self, version: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        """Sums over numbers from ``number`` on, in each asked version."""
        inside = number < self.size
        totals = [np.zeros(len(version), np.int64) for _ in self.levels[0][2]]
        # copies of the node on the way: those before the version, less those before the node
        low, high = np.zeros(len(version), np.int64), np.where(inside, version, 0)
        for bit, went_left, sums in self.levels:
            lefts = int(went_left[-1])
            left_low, left_high = went_left[low].astype(np.int64), went_left[high].astype(np.int64)
            right_low, right_high = lefts + low - left_low, lefts + high - left_high
            go_right = number >> bit & 1 == 1
            for total, s in zip(totals, sums, strict=True):
                total += np.where(go_right, 0, s[right_high] - s[right_low])
            low, high = np.where(go_right, right_low, left_low), np.where(go_right, right_high, left_high)
        for total, s in zip(totals, self.levels[-1][2], strict=True):
            total += s[high] - s[low]
        return totals


class Timeline:
    """A tree over one kind of event: ``at`` and ``known`` are keys that start with the client."""

    def __init__(self, at: np.ndarray, known: np.ndarray, values: list[np.ndarray], tie: np.ndarray | None = None):
        self.by_time = np.lexsort((at,) if tie is None else (tie, at))
        number = np.empty(len(at), np.int64)
        number[self.by_time] = np.arange(len(at))
        inserted = np.argsort(known, kind="stable")
        self.at, self.known = at[self.by_time], known[inserted]
        self.latest = np.maximum.accumulate(number[inserted]) if len(at) else number
        self.tree = PersistentTree(number[inserted], [v[inserted] for v in values])

    def window(self, now: np.ndarray, since: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums of what is known at ``now`` and later than ``since``, and which event is the latest of these (-1: none)."""
        version, number = np.searchsorted(self.known, now, side="right"), np.searchsorted(self.at, since, side="right")
        if not len(self.at):
            return self.tree.since(version, number), np.full(len(now), -1)
        latest = np.where(version > 0, self.latest[np.maximum(version, 1) - 1], -1)
        return self.tree.since(version, number), np.where(latest >= number, self.by_time[latest], -1)


def item_points(client: np.ndarray, item: np.ndarray, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves of each item's latest known occurrence: time, when known, +1 or -1."""
    order = np.lexsort((at, known, item, client))
    client, item, at, known = (x[order] for x in (client, item, at, known))
    same = np.concatenate(([False], (client[1:] == client[:-1]) & (item[1:] == item[:-1]))) if len(at) else np.zeros(0, bool)
    times, rank = np.unique(at, return_inverse=True)
    latest = np.maximum.accumulate(np.cumsum(~same) << 32 | rank) if len(at) else rank
    before = np.concatenate(([0], latest[:-1])) & 0xFFFFFFFF if len(at) else rank
    new = ~same | (rank > before)
    moved = new & same
    return np.concatenate((at[new], times[before[moved]])), np.concatenate((known[new], known[moved])), np.concatenate((np.ones(new.sum(), np.int64), -np.ones(moved.sum(), np.int64)))


def _features(windows: tuple[int, ...], label_days: int):
    def run(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        at, known = rows["at"].to_numpy(), pc.fill_null(rows["known"], np.iinfo(np.int64).max).to_numpy()
        raw = rows["id"].combine_chunks()
        held, id_ = pc.is_valid(raw).to_numpy(zero_copy_only=False), pc.fill_null(raw, np.iinfo(np.int64).min).to_numpy()
        n, more, cent = (rows[c].to_numpy() for c in ("n", "more", "cents"))
        client = np.unique(rows["client"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        asked = np.flatnonzero(kind == QUERY)
        asks = {0: at[asked], -label_days: at[asked] + label_days * DAY} | {d: at[asked] - d * DAY for d in windows}
        grid = np.unique(np.concatenate((at, known, *asks.values())))
        key = lambda who, when: who << 32 | np.searchsorted(grid, when)
        at_key, known_key = key(client, at), key(client, known)
        ask = {d: key(client[asked], when) for d, when in asks.items()}
        of = lambda k: np.flatnonzero((kind == k) & (known < np.iinfo(np.int64).max))
        clicks, sales, lines = of(CLICK), of(SALE), of(LINE)
        clicked = Timeline(at_key[clicks], known_key[clicks], [n[clicks], more[clicks], cent[clicks]], id_[clicks])
        sold = Timeline(at_key[sales], known_key[sales], [n[sales], cent[sales]])
        lined = Timeline(at_key[lines], known_key[lines], [n[lines], cent[lines]])
        named = lines[held[lines]]
        point_at, point_known, point = item_points(client[named], id_[named], at_key[named], known_key[named])
        items = Timeline(point_at, point_known, [point])
        all_sales = np.sort(at_key[kind == SALE])
        label = np.searchsorted(all_sales, ask[0], side="right") < np.searchsorted(all_sales, ask[-label_days], side="right")
        out = []
        for d in windows:
            (n_clicks, n_purchases, click_cents), last = clicked.window(ask[0], ask[d])
            (n_sales, sale_cents), _ = sold.window(ask[0], ask[d])
            (n_lines, line_cents), _ = lined.window(ask[0], ask[d])
            (n_items,), _ = items.window(ask[0], ask[d])
            none = last < 0
            last_at, last_id = (pa.array(np.zeros(len(last), np.int64), mask=none) if not len(clicks) else pa.array(x[clicks][last], mask=none) for x in (at, id_))
            last_id = pc.if_else(pc.equal(last_id, np.iinfo(np.int64).min), None, last_id)
            out.append(pa.table({"uid": pa.array(more[asked]), "sale_id": raw.take(pa.array(asked)), "d": pa.array(np.full(len(asked), d, np.int32)), "t_us": at[asked], "label": label, "part": rows["part"].take(pa.array(asked)), "n_clicks": n_clicks, "n_purchases": n_purchases, "click_cents": click_cents, "last_at": last_at, "last_click_id": last_id, "n_sales": n_sales, "sale_cents": sale_cents, "n_lines": n_lines, "n_items": n_items, "line_cents": line_cents}))
        return pa.concat_tables(out)

    return run


SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
_OUT = "uid long, sale_id long, d int, t_us long, label boolean, part boolean, n_clicks long, n_purchases long, click_cents long, last_at long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long"


def window_features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, label_days: int = LABEL_DAYS, delay: int = DELAY) -> DataFrame:
    """One row per sale and window."""
    rows = written(events(clicks, sales, lines, delay), "time-events")
    found = written(cells(rows, windows, label_days).groupBy("group", "slice", "salt").applyInArrow(_features(windows, label_days), _OUT), "time-found")
    last = F.max(F.struct("last_at", "last_click_id"))
    parts = found.where("part").groupBy("uid", "sale_id", "d", "t_us").agg(F.bool_or("label").alias("label"), last["last_click_id"].alias("last_click_id"), *(F.sum(c).alias(c) for c in SUMS))
    return found.where("NOT part").select(*parts.columns).unionByName(parts).drop("uid")


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales, lines = (table(spark, sf_dir, name) for name in ("clicks", "sales", "sale_lines"))
    return window_features(clicks, sales, lines).select("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


OP13_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
s AS (SELECT row_number() OVER () AS rid, *, coalesce(sale_id::VARCHAR, '') AS x FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
a AS (SELECT s.*, sold_at + to_seconds(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) + 1), lambda j: CAST(ascii(x[j]) AS BIGINT))), lambda c, y: xor(c >> 8, crc.k[(xor(c, y) & 255) + 1])), 4294967295) % 259200) AS t FROM s, crc),
q AS (SELECT rid, sale_id, client_id, t, d FROM a, (VALUES (2), (14)) v(d)),
c AS (SELECT DISTINCT * FROM clicks),
ca AS (SELECT rid, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(coalesce(floor(100 * value + 0.5::DOUBLE), 0)) AS click_cents, first(click_id ORDER BY ts DESC, click_id DESC) AS last_click_id FROM q JOIN c USING (client_id) WHERE ts <= t AND ts > t - to_days(d) AND arrived_at + INTERVAL 240 MINUTE <= t GROUP BY rid, d),
sa AS (SELECT q.rid, d, count(*) AS n_sales, sum(coalesce(floor(100 * total + 0.5::DOUBLE), 0)) AS sale_cents FROM q JOIN s USING (client_id) WHERE sold_at <= t AND sold_at > t - to_days(d) AND arrived_at + INTERVAL 240 MINUTE <= t GROUP BY q.rid, d),
la AS (SELECT q.rid, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(floor(100 * amount + 0.5::DOUBLE), 0)) AS line_cents FROM q JOIN s USING (client_id) JOIN sale_lines l ON l.sale_id = s.sale_id WHERE sold_at <= t AND sold_at > t - to_days(d) AND arrived_at + INTERVAL 240 MINUTE <= t AND shipped_at <= t GROUP BY q.rid, d),
b AS (SELECT DISTINCT q.rid FROM q JOIN s USING (client_id) WHERE sold_at > t AND sold_at <= t + INTERVAL 7 DAY)
SELECT q.sale_id, d::INTEGER AS d, epoch_us(t) AS t_us, b.rid IS NOT NULL AS label, coalesce(n_clicks, 0)::BIGINT AS n_clicks, coalesce(n_purchases, 0)::BIGINT AS n_purchases, coalesce(click_cents, 0)::BIGINT AS click_cents, last_click_id, coalesce(n_sales, 0)::BIGINT AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM q LEFT JOIN ca USING (rid, d) LEFT JOIN sa USING (rid, d) LEFT JOIN la USING (rid, d) LEFT JOIN b USING (rid)
"""
