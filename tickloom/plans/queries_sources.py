"""Readers, writers and normalisers, fed with text the tables are rendered into."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import costs
from tickloom.operators import grid
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.registry import query
from tickloom.session import checkpoint_dir
from tickloom.sources import archives, messages, prints as prints_, store


def scratch(fx: Fixtures) -> str:
    """A new folder in the shared place the session names."""
    return f"{checkpoint_dir(fx.spark)}/planes-{uuid.uuid4().hex}"


def text(name: str, alias: str) -> Column:
    return F.col(name).cast("string").alias(alias)


STORED = """
    SELECT symbol, strftime(make_timestamp(us // 86400000000 * 86400000000), '%Y-%m-%d') AS day,
      count(*) AS rows, sum(size) AS volume FROM fx_prints"""


@query("s1_read_plane", STORED + " WHERE us // 86400000000 >= 19730 GROUP BY 1, 2", d="volume")
def s1(fx: Fixtures) -> DataFrame:
    path = scratch(fx)
    store.write_plane(fx.prints, path, "prints")
    back = store.read_plane(fx.spark, path, "prints", first_day="2024-01-08")
    return back.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("volume")
    )


@query(
    "s2_write_manifest",
    """
    SELECT 'prints' AS plane, count(*) AS rows, count(DISTINCT symbol) AS symbols,
      min(us) AS first_us, max(us) AS last_us FROM fx_prints""",
)
def s2(fx: Fixtures) -> DataFrame:
    path = scratch(fx)
    store.write_plane(fx.prints, path, "prints")
    manifest = fx.spark.read.parquet(f"{path}/_manifests/prints")
    return manifest.select("plane", "rows", "symbols", "first_us", "last_us")


@query(
    "s3_discover_planes",
    """
    SELECT 'book' AS plane, 1 AS depth, true AS sampled, count(*) AS rows FROM
      (SELECT DISTINCT symbol, us // 900000000 FROM fx_book)
    UNION ALL SELECT 'prints', 0, false, count(*) FROM fx_prints""",
    i="depth",
)
def s3(fx: Fixtures) -> DataFrame:
    path = scratch(fx)
    store.write_plane(fx.prints, path, "prints")
    touch = ["bid_price_0", "bid_size_0", "ask_price_0", "ask_size_0"]
    sampled = grid.last_per_bin(fx.book, 900, touch)
    store.write_plane(sampled, path, "book", sampled_s=900)
    parts = [
        fx.spark.read.parquet(f"{path}/{p.plane}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(p.plane).alias("plane"),
            F.lit(p.depth).alias("depth"),
            F.lit(p.sampled).alias("sampled"),
            "rows",
        )
        for p in store.discover(fx.spark, path)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "s4_agg_trades_csv",
    """
    SELECT symbol, us // 1000 * 1000 AS us, price, quantity, is_buyer_maker, trade_id
    FROM fx_trades""",
    d="price quantity",
)
def s4(fx: Fixtures) -> DataFrame:
    path = scratch(fx)
    rendered = fx.trades.select(
        "symbol",
        text("trade_id", "aggregate_trade_id"),
        text("price", "p"),
        text("quantity", "qty"),
        F.floor(F.col("us") / 1000).cast("string").alias("timestamp"),
        F.initcap(F.col("is_buyer_maker").cast("string")).alias("m"),
    )
    rendered.write.option("header", True).csv(path)
    raw = archives.read_csv(fx.spark, path)
    out = archives.agg_trades(raw, F.col("symbol"), "archive")
    return out.select(
        "symbol",
        F.unix_micros("ts").alias("us"),
        "price",
        "quantity",
        "is_buyer_maker",
        "trade_id",
    )


@query(
    "s5_book_ticker_csv",
    "SELECT symbol, us // 1000 * 1000 AS us, seq AS sequence_id, bid_price_0, bid_size_0, "
    "ask_price_0, ask_size_0 FROM fx_book",
    d="bid_price_0 bid_size_0 ask_price_0 ask_size_0",
)
def s5(fx: Fixtures) -> DataFrame:
    raw = fx.book.select(
        "symbol",
        text("seq", "update_id"),
        text("bid_price_0", "best_bid_price"),
        text("bid_size_0", "best_bid_qty"),
        text("ask_price_0", "best_ask_price"),
        text("ask_size_0", "best_ask_qty"),
        F.floor(F.col("us") / 1000).cast("string").alias("transaction_time"),
    )
    out = archives.book_ticker(raw, F.col("symbol"), "archive")
    return out.select(
        "symbol",
        F.unix_micros("ts").alias("us"),
        "sequence_id",
        "bid_price_0",
        "bid_size_0",
        "ask_price_0",
        "ask_size_0",
    )


@query(
    "s6_book_depth_pivot",
    "WITH l AS (SELECT symbol, us // 1800000000 AS timestamp, trade_id % 5 + 1 AS p, aggressor, "
    "size, price, trade_id FROM fx_prints) SELECT symbol, timestamp, "
    + ", ".join(
        f"arg_max({v}, CASE WHEN p * aggressor = {p} THEN trade_id END) AS "
        f"{n}_{'bid' if p < 0 else 'ask'}_{abs(p)}pct"
        for n, v in (("depth", "size"), ("notional", "size * price"))
        for p in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)
    )
    + " FROM l GROUP BY 1, 2",
    d=" ".join(
        f"{n}_{s}_{p}pct" for n in ("depth", "notional") for s in ("bid", "ask") for p in range(1, 6)
    ),
)
def s6(fx: Fixtures) -> DataFrame:
    raw = fx.prints.select(
        "symbol",
        F.floor(F.col("us") / F.lit(1_800_000_000)).cast("long").alias("timestamp"),
        ((F.col("trade_id") % 5 + 1) * F.col("aggressor")).cast("string").alias("percentage"),
        text("size", "depth"),
        (F.col("size") * F.col("price")).cast("string").alias("notional"),
        F.col("trade_id").alias("line"),
    )
    return archives.book_depth(raw)


@query(
    "s7_metrics_csv",
    """
    SELECT symbol, us // 1000000 * 1000000 AS us,
      CASE WHEN trade_id % 9 <> 0 THEN size * 1000 END AS sum_open_interest,
      price / 100 AS count_long_short_ratio FROM fx_prints""",
    d="sum_open_interest count_long_short_ratio",
)
def s7(fx: Fixtures) -> DataFrame:
    interest = F.when(F.col("trade_id") % 9 == 0, "n/a").otherwise(
        (F.col("size") * 1000).cast("string")
    )
    raw = fx.prints.select(
        "symbol",
        F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        interest.alias("sum_open_interest"),
        (F.col("price") / 100).cast("string").alias("count_long_short_ratio"),
    )
    out = archives.metrics(raw, F.col("symbol"), "archive")
    return out.select(
        "symbol", F.unix_micros("ts").alias("us"), "sum_open_interest", "count_long_short_ratio"
    )


@query(
    "s8_funding_csv",
    "SELECT symbol, us, rate AS funding_rate, 8 AS funding_interval_hours FROM fx_funding",
    d="funding_rate funding_interval_hours",
    digits=9,
)
def s8(fx: Fixtures) -> DataFrame:
    raw = fx.funding.select(
        "symbol",
        F.floor(F.col("us") / 1000).cast("string").alias("calc_time"),
        text("rate", "last_funding_rate"),
    )
    out = archives.funding_rate(raw, F.col("symbol"), "archive")
    return out.select(
        "symbol", F.unix_micros("ts").alias("us"), "funding_rate", "funding_interval_hours"
    )


@query(
    "s9_klines_csv",
    "SELECT symbol, us, open_us, open, high, low, close, volume FROM fx_bars",
    d="open high low close volume",
)
def s9(fx: Fixtures) -> DataFrame:
    raw = fx.bars.select(
        "symbol",
        F.floor(F.col("open_us") / 1000).cast("string").alias("open_time"),
        *[text(c, c) for c in ("open", "high", "low", "close", "volume")],
        F.floor(F.col("us") / 1000).cast("string").alias("close_time"),
    )
    out = archives.klines(raw, F.col("symbol"), "archive")
    return out.select(
        "symbol",
        F.unix_micros("ts").alias("us"),
        F.unix_micros("open_time").alias("open_us"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


@query(
    "s10_trim_to_day",
    "SELECT symbol, us, trade_id FROM fx_prints WHERE us // 86400000000 = 19732",
)
def s10(fx: Fixtures) -> DataFrame:
    stamped = fx.prints.withColumn("ts", F.timestamp_micros("us"))
    return archives.within_day(stamped, date(2024, 1, 10)).select("symbol", "us", "trade_id")


@query(
    "s10_rows_outside_day",
    "SELECT count(*) FILTER (us // 86400000000 <> 19732) AS rows_outside FROM fx_prints",
)
def s10b(fx: Fixtures) -> DataFrame:
    return archives.rows_outside_day(fx.prints, date(2024, 1, 10))


@query(
    "s11_prints_csv",
    "SELECT symbol, us, price, size, aggressor FROM fx_prints",
    d="price size",
    i="aggressor",
)
def s11(fx: Fixtures) -> DataFrame:
    raw = fx.prints.select(
        "symbol",
        (F.col("us").cast("decimal(38,6)") / 1_000_000).cast("decimal(38,6)").cast("string").alias(
            "timestamp"
        ),
        F.when(F.col("aggressor") == 1, "Buy").otherwise("Sell").alias("side"),
        text("size", "size"),
        text("price", "price"),
    )
    return archives.prints_csv(raw, F.col("symbol"))


@query(
    "s12_prints_contract",
    """
    SELECT count(*) AS rows, 0 AS bad_aggressor, 0 AS bad_price, 0 AS bad_size FROM fx_prints""",
    i="bad_aggressor bad_price bad_size",
)
def s12(fx: Fixtures) -> DataFrame:
    return prints_.contract_findings(prints_.assemble(fx.prints, "events"))


@query(
    "s13_trades_prints",
    """
    SELECT symbol, us, price, quantity AS size,
      CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS aggressor, trade_id FROM fx_trades""",
    d="price size",
    i="aggressor",
)
def s13(fx: Fixtures) -> DataFrame:
    return prints_.trades_to_prints(prints_.prints_to_trades(fx.prints))


def book_log(fx: Fixtures) -> DataFrame:
    """Prints rendered as book messages: a day opens with a snapshot, then one level a message."""
    day = F.floor(F.col("us") / F.lit(86_400_000_000))
    opens = fx.prints.groupBy("symbol", day.alias("_day")).agg(
        F.min_by("trade_id", F.struct("us", "trade_id")).alias("_first")
    )
    base = fx.prints.withColumn("_day", day).join(opens, ["symbol", "_day"])
    px, qty = F.floor(F.col("price")).cast("int"), F.pmod(F.col("size"), F.lit(5)).cast("int")
    snapshot = F.col("trade_id") == F.col("_first")

    def level(p: Column, s: Column) -> Column:
        return F.format_string('["%d","%d"]', p, s)

    bids = F.concat_ws(",", *[level(px - 1 - i, F.lit(i + 1)) for i in range(3)])
    asks = F.concat_ws(",", *[level(px + 1 + i, F.lit(i + 2)) for i in range(3)])
    one_bid = F.when(F.col("aggressor") == -1, level(px - 1, qty)).otherwise(F.lit(""))
    one_ask = F.when(F.col("aggressor") == 1, level(px + 1, qty)).otherwise(F.lit(""))
    text_ = F.format_string(
        '{"topic":"orderbook.50.X","type":"%s","ts":%d,"data":{"u":%d,"b":[%s],"a":[%s]}}',
        F.when(snapshot, "snapshot").otherwise("delta"),
        F.floor(F.col("us") / 1000).cast("long"),
        "trade_id",
        F.when(snapshot, bids).otherwise(one_bid),
        F.when(snapshot, asks).otherwise(one_ask),
    )
    return base.select("symbol", F.col("trade_id").alias("recv"), text_.alias("text"))


@query(
    "s14_depth_messages",
    """
    WITH o AS (SELECT symbol, us // 86400000000 AS day, arg_min(trade_id, us) AS first
               FROM fx_prints GROUP BY 1, 2)
    SELECT p.symbol, p.trade_id AS recv, us // 1000 * 1000 AS us,
      CASE WHEN trade_id = first THEN 'snapshot' ELSE 'delta' END AS kind,
      CASE WHEN trade_id = first THEN 6 ELSE 1 END AS levels
    FROM fx_prints p JOIN o ON p.symbol = o.symbol AND p.us // 86400000000 = o.day""",
    i="levels",
)
def s14(fx: Fixtures) -> DataFrame:
    decoded = messages.level_changes(messages.book_messages(book_log(fx)))
    return decoded.groupBy("symbol", "recv", "us", "kind").agg(F.count(F.lit(1)).alias("levels"))


def trade_log(fx: Fixtures) -> DataFrame:
    text_ = F.format_string(
        '{"topic":"publicTrade.X","ts":%d,"data":[{"T":%d,"S":"%s","v":"%s","p":"%s","seq":%d}]}',
        F.floor(F.col("us") / 1000).cast("long"),
        F.floor(F.col("us") / 1000).cast("long"),
        F.when(F.col("aggressor") == 1, "Buy").otherwise("Sell"),
        F.col("size").cast("string"),
        F.col("price").cast("string"),
        "trade_id",
    )
    return fx.prints.select("symbol", text_.alias("text"))


@query(
    "s15_raw_log_days",
    """
    SELECT symbol, strftime(make_timestamp(us // 86400000000 * 86400000000), '%Y-%m-%d') AS day,
      count(*) AS prints, sum(size) AS volume, sum(price * size) AS notional
    FROM fx_prints GROUP BY 1, 2""",
    d="volume notional",
    digits=4,
)
def s15(fx: Fixtures) -> DataFrame:
    path = scratch(fx)
    log = trade_log(fx).unionByName(book_log(fx).select("symbol", "text"))
    parsed = messages.trade_messages(log)
    store.write_plane(parsed, path, "prints")
    back = store.read_plane(fx.spark, path, "prints")
    return back.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("prints"),
        F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("notional"),
    )


@query(
    "s16_feature_store",
    """
    WITH m AS (SELECT median(v) AS t FROM (SELECT bid_size_0 AS v FROM fx_book UNION ALL
               SELECT ask_size_0 FROM fx_book))
    SELECT symbol, us, seq, CAST(CAST(bid_size_0 / t AS FLOAT) AS DOUBLE) AS bid_size_0,
      CAST(CAST(bid_price_0 AS FLOAT) AS DOUBLE) AS bid_price_0 FROM fx_book, m""",
    d="bid_size_0 bid_price_0",
    digits=4,
)
def s16(fx: Fixtures) -> DataFrame:
    inputs = fx.book.select("symbol", "us", "seq", "bid_size_0", "bid_price_0")
    scale = store.median_touch_size(fx.book)
    return store.to_stored(inputs, ["bid_size_0"], scale, ["symbol", "us", "seq"])


@query(
    "s16_finiteness",
    """
    SELECT 'notional' AS "column", 0 AS infinite,
      count_if(price * size * 30 > 65504) AS overflow FROM fx_prints
    UNION ALL SELECT 'price', 0, count_if(price > 65504) FROM fx_prints""",
    i="infinite overflow",
)
def s16b(fx: Fixtures) -> DataFrame:
    frame = fx.prints.withColumn("notional", F.col("price") * F.col("size") * 30)
    return store.finiteness(frame, ["price", "notional"])


TIER_ROWS = ", ".join(f"('{t}', {m}, {k}, '{g}')" for t, m, k, g in costs.LINEAR_TIERS)
TIERS = f"fees AS (SELECT * FROM (VALUES {TIER_ROWS}) v(tier, maker_bp, taker_bp, grp))"


@query(
    "s17_fee_table",
    f"""
    WITH {TIERS}, c AS (SELECT l_returnflag, sum(l_extendedprice) AS turnover FROM lineitem
                        GROUP BY 1)
    SELECT l_returnflag, tier, turnover * maker_bp / 1e4 AS maker_fee,
      turnover * taker_bp / 1e4 AS taker_fee FROM c CROSS JOIN fees
    WHERE grp IN ('all', 'altcoin')""",
    d="maker_fee taker_fee",
    digits=2,
)
def s17(fx: Fixtures) -> DataFrame:
    ladder = costs.tiers_for(costs.fee_table(fx.spark), "altcoin")
    turnover = fx.table("lineitem").groupBy("l_returnflag").agg(
        F.sum("l_extendedprice").alias("turnover")
    )
    return turnover.join(F.broadcast(ladder)).select(  # 13 rows
        "l_returnflag",
        "tier",
        (F.col("turnover") * F.col("maker_bp") / 1e4).alias("maker_fee"),
        (F.col("turnover") * F.col("taker_bp") / 1e4).alias("taker_fee"),
    )


@query(
    "s18_stage_output",
    """
    SELECT symbol, strftime(make_timestamp(us // 86400000000 * 86400000000), '%Y-%m-%d') AS day,
      count(*) AS rows, min(us) AS first_us, max(us) AS last_us FROM fx_book GROUP BY 1, 2""",
)
def s18(fx: Fixtures) -> DataFrame:
    from tickloom.functions.book import build_features

    path = scratch(fx)
    features = build_features(fx.book, ["spread_bp", "queue_imbalance"])
    store.write_plane(features, path, "features")
    back = store.read_plane(fx.spark, path, "features")
    return back.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )


@query(
    "s19_touch_from_prints",
    """
    WITH t AS (SELECT symbol, us,
        last_value(CASE WHEN aggressor = 1 THEN price END IGNORE NULLS) OVER w AS ask_proxy,
        last_value(CASE WHEN aggressor = -1 THEN price END IGNORE NULLS) OVER w AS bid_proxy,
        row_number() OVER (PARTITION BY symbol, us // 60000000 ORDER BY us, trade_id) AS n
      FROM fx_prints WINDOW w AS (PARTITION BY symbol ORDER BY us, trade_id))
    SELECT symbol, us, ask_proxy, bid_proxy, (ask_proxy + bid_proxy) / 2 AS mid_proxy
    FROM t WHERE n = 1""",
    d="ask_proxy bid_proxy mid_proxy",
)
def s19(fx: Fixtures) -> DataFrame:
    return prints_.print_grid(fx.prints, 60_000)


@query(
    "s20_touch_from_bars",
    """
    WITH g AS (SELECT symbol, unnest(range(min(us), max(us) + 1, 900000000)) AS us
               FROM fx_bars GROUP BY 1),
    f AS (SELECT symbol, us, last_value(close IGNORE NULLS) OVER
            (PARTITION BY symbol ORDER BY us) AS c FROM g LEFT JOIN fx_bars USING (symbol, us))
    SELECT symbol, us, c * (1 - 0.75e-4) AS bid_price_0, c * (1 + 0.75e-4) AS ask_price_0 FROM f""",
    d="bid_price_0 ask_price_0",
)
def s20(fx: Fixtures) -> DataFrame:
    return grid.bar_touch(fx.bars, 900, 0.75)


@query(
    "s21_last_of_repeated_bars",
    """
    SELECT symbol, us, CASE WHEN hour % 3 = 0 THEN close + 1 ELSE close END AS close FROM fx_bars""",
    d="close",
)
def s21(fx: Fixtures) -> DataFrame:
    first = fx.bars.select("symbol", "us", "close", F.lit(1).alias("load"))
    again = fx.bars.filter("hour % 3 = 0").select(
        "symbol", "us", (F.col("close") + 1).alias("close"), F.lit(2).alias("load")
    )
    return store.latest_bars(first.unionByName(again), "load").drop("load")


@query(
    "s22_recorded_grid",
    """
    WITH k AS (SELECT * FROM fx_book WHERE us <= 1705276800000000),
    d AS (SELECT DISTINCT symbol, us // 86400000000 AS day FROM k),
    ok AS (SELECT symbol FROM d GROUP BY 1 HAVING count(*) =
           (SELECT count(DISTINCT day) FROM d)),
    b AS (SELECT symbol, us // 86400000000 AS day, us // 600000000 AS bin,
      arg_max(bid_price_0, us) AS bid, arg_max(ask_price_0, us) AS ask
      FROM k WHERE symbol IN (SELECT symbol FROM ok) GROUP BY 1, 2, 3),
    g AS (SELECT symbol, day, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1, 2)
    SELECT symbol, (bin + 1) * 600000000 AS us,
      last_value(bid IGNORE NULLS) OVER w AS bid_price_0,
      last_value(ask IGNORE NULLS) OVER w AS ask_price_0
    FROM g LEFT JOIN b USING (symbol, day, bin)
    WINDOW w AS (PARTITION BY symbol, day ORDER BY bin)""",
    d="bid_price_0 ask_price_0",
)
def s22(fx: Fixtures) -> DataFrame:
    from tickloom.functions.columns import day_of

    until = 1_705_276_800_000_000
    days = fx.stamps.filter(F.col("us") <= until).select(day_of("us").alias("day"))
    return grid.recorded_grid(fx.book, days, 600, until, ["bid_price_0", "ask_price_0"])
