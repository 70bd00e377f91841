"""DataFrame → DataFrame operators, all lazy and built from Spark built-ins.

quality   checks: preview, counts, duplicate keys, NULL rows and profile, non-positive
          amounts, date range, distinct values, basket-key collisions
enrich    derived columns: time parts and names, revenue, basket key, quarter, group
summary   ``summarize`` with a metric vocabulary (units, revenue, lines, baskets, ratios)
growth    ``period_growth``: month / quarter totals, previous period, growth
ranking   ``rank_within`` (window or range-sliced), ``bottom_within``
basket    basket contents, combos, top combos, products inside one combo
pricing   price lists, daily units, within-day elasticity, change days, hold-price what-if
traffic   hour-of-day traffic, basket size by time, peak hours
joins     broadcast policy: ``bounded_broadcast``, ``growing``
"""
