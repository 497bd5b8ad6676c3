"""Explicit schemas as DDL. Readers never infer; malformed rows are quarantined."""

from __future__ import annotations

BAR = ("universe STRING, asset STRING, idx BIGINT, ts TIMESTAMP, open DOUBLE, high DOUBLE, "
              "low DOUBLE, close DOUBLE, volume DOUBLE, amount DOUBLE")
ASSET = ("universe STRING, asset STRING, ordinal INT, tier STRING")
WINDOW = ("universe STRING, origin BIGINT, asset STRING, hist ARRAY<DOUBLE>, "
                 "fut ARRAY<DOUBLE>")
PATH = ("forecast_id STRING, method STRING, path_id INT, asset STRING, step INT, "
               "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, amount DOUBLE")
HOLDING = ("portfolio_id STRING, asset STRING, weight DOUBLE, quantity DOUBLE, "
                  "price DOUBLE")
TRIGGER = ("universe STRING, k INT, idx BIGINT, ts TIMESTAMP, asset STRING, "
                  "direction INT, magnitude DOUBLE")
EVENT = ("universe STRING, k INT, t0 BIGINT, ts TIMESTAMP, origins ARRAY<STRING>, "
                "direction INT, magnitude DOUBLE, systemic BOOLEAN, eligible BOOLEAN, "
                "reasons ARRAY<STRING>, members ARRAY<STRUCT<idx BIGINT, asset STRING, "
                "direction INT, magnitude DOUBLE>>")
SLOT = ("universe STRING, t0 BIGINT, asset STRING, present BOOLEAN, direction INT, "
               "magnitude DOUBLE, delay INT")
SCORE = ("task_id STRING, window_id STRING, as_of TIMESTAMP, asset STRING, model STRING, "
                "metric STRING, predicted DOUBLE, actual DOUBLE, absolute_error DOUBLE, "
                "status STRING, regime STRING")
LEDGER = ("task_id STRING, status STRING, reason STRING")
SNAPSHOT = ("universe STRING, asset STRING, ts TIMESTAMP, close DOUBLE, vol30 DOUBLE, "
                   "ret30 DOUBLE, mdd30 DOUBLE, ratio DOUBLE, state STRING, reason STRING, "
                   "closes ARRAY<DOUBLE>")
# The twelve positional columns of an exchange kline archive; read as text so that a malformed
# cell is kept and explained instead of silently becoming null.
KLINE_COLUMNS = ("open_us", "open", "high", "low", "close", "volume", "close_us", "quote_amount",
                 "trades", "taker_base", "taker_quote", "ignored")
