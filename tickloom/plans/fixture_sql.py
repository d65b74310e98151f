"""The derived market planes as SQL, for the side-by-side check."""

W = "(PARTITION BY symbol ORDER BY us, trade_id)"

VIEWS: dict[str, str] = {
    "fx_prints": """
        SELECT event_type AS symbol, ts, epoch_us(ts) AS us, 100 + value / 100 AS price,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size,
               CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS aggressor, event_id AS trade_id
        FROM events""",
    "fx_trades": """
        SELECT symbol, us, price, size AS quantity, aggressor = -1 AS is_buyer_maker, trade_id
        FROM fx_prints""",
    "fx_touch": f"""
        SELECT * FROM (
          SELECT symbol, us, trade_id AS seq,
            last_value(CASE WHEN aggressor = 1 THEN price END IGNORE NULLS) OVER w AS ask_proxy,
            last_value(CASE WHEN aggressor = -1 THEN price END IGNORE NULLS) OVER w AS bid_proxy,
            last_value(CASE WHEN aggressor = 1 THEN size END IGNORE NULLS) OVER w AS ask_sz,
            last_value(CASE WHEN aggressor = -1 THEN size END IGNORE NULLS) OVER w AS bid_sz
          FROM fx_prints WINDOW w AS {W})
        WHERE ask_proxy IS NOT NULL AND bid_proxy IS NOT NULL""",
    "fx_book_raw": """
        SELECT symbol, us, seq, bid_proxy AS bid_price_0, bid_sz AS bid_size_0,
               ask_proxy AS ask_price_0, ask_sz AS ask_size_0 FROM fx_touch""",
    "fx_book": "SELECT symbol, us, seq, "
    + ", ".join(
        f"least(bid_proxy, ask_proxy) - 0.01 - 0.01 * {i} AS bid_price_{i}, "
        f"greatest(bid_proxy, ask_proxy) + 0.01 + 0.01 * {i} AS ask_price_{i}, "
        f"1 + (bid_sz + 3 * {i}) % 11 AS bid_size_{i}, "
        f"1 + (ask_sz + 3 * {i}) % 11 AS ask_size_{i}"
        for i in range(5)
    )
    + " FROM fx_touch",
    "fx_bars": """
        SELECT symbol, us // 3600000000 AS hour, (us // 3600000000) * 3600000000 AS open_us,
               (us // 3600000000 + 1) * 3600000000 AS us,
               arg_min(price, (us, trade_id)) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, (us, trade_id)) AS close, sum(size) AS volume
        FROM fx_prints GROUP BY 1, 2""",
    "fx_funding": """
        SELECT symbol, (open_us // 28800000000 + 1) * 28800000000 AS us,
               (arg_max(close, us) / arg_min(open, us) - 1) / 100 AS rate
        FROM fx_bars GROUP BY 1, 2""",
    "fx_venue": """
        SELECT symbol, CASE WHEN aggressor = 1 THEN 'A' ELSE 'B' END AS venue, us, price, trade_id
        FROM fx_prints""",
    "fx_carry": """
        SELECT coin, day, CAST(date_trunc('month', day) AS DATE) AS month, spot,
               spot * (1 + (n % 7 - 3) * 1e-4) AS perp, (n % 5 - 2) * 1e-4 AS rate
        FROM (SELECT o_orderpriority AS coin, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
                     100 + avg(o_totalprice) / 1e4 AS spot
              FROM orders GROUP BY 1, 2)""",
    "fx_decisions": """
        SELECT symbol, us, seq, mid, spread_bp, imb, 0.5 + imb / 2 AS p_buy,
               1 - (0.5 + imb / 2) AS p_sell,
               CASE WHEN 0.5 + imb / 2 > 0.6 THEN 1 WHEN 1 - (0.5 + imb / 2) > 0.6 THEN -1
                    ELSE 0 END AS side
        FROM (SELECT symbol, us, seq, (bid_price_0 + ask_price_0) / 2 AS mid,
                1e4 * (ask_price_0 - bid_price_0) / ((bid_price_0 + ask_price_0) / 2) AS spread_bp,
                (bid_size_0 - ask_size_0) / (bid_size_0 + ask_size_0) AS imb FROM fx_book)""",
    "fx_li_trades": """
        SELECT l_orderkey AS okey, l_linenumber AS line, l_returnflag || l_linestatus AS series,
               CAST(l_shipdate AS DATE) AS day, (l_discount - 0.05) * 1e4 AS gross_bp,
               l_tax * 100 AS cost_bp, (l_discount - 0.05) * 1e4 - l_tax * 100 AS net_bp
        FROM lineitem""",
    "fx_cells": """
        SELECT printf('%d|%s|%d', a_line, a_flag, a_qty) AS key, a_line, a_flag, a_qty, day,
               count(*) AS trades, sum((l_discount - 0.05) * 1e4 - l_tax * 100) AS net_bp,
               sum((l_discount - 0.05) * 1e4) AS g_bp
        FROM (SELECT CAST(l_linenumber AS BIGINT) AS a_line, l_returnflag AS a_flag,
                     CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS a_qty,
                     CAST(l_shipdate AS DATE) AS day, l_discount, l_tax FROM lineitem)
        GROUP BY ALL""",
}
