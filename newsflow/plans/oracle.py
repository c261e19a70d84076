"""The catalog's results stated in DuckDB SQL over the same tables.

Views are common table expressions; a statement names the ones it needs and they bring their own.
"""

from __future__ import annotations

from newsflow.functions.scoring import DEFAULT_KEYWORDS
from newsflow.functions.text import SCRIPT_SPACE
from newsflow.plans.views import RAW_SHAPES, SECOND_KEYWORDS, THRESHOLD
from newsflow.schemas import RAW_FIELDS
from newsflow.sources.seed import SEED_ARTICLES, SEED_TOPICS

NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def _score(text: str, words: tuple[str, ...]) -> str:
    hits = " + ".join(f"contains(lower({text}), '{w}')::INTEGER" for w in words)
    return (
        f"round(least(1.0::DOUBLE, least(0.9::DOUBLE, ({hits}) * 0.15::DOUBLE)"
        f" + (('0x' || substr(md5({text}), 1, 4))::INTEGER % 100) / 1000.0::DOUBLE + 0.05::DOUBLE), 3)"
    )


def _label(score: str) -> str:
    return f"CASE WHEN {score} IS NULL THEN 'unknown' WHEN {score} >= 0.5 THEN 'biased' ELSE 'neutral' END"


def _uuid(*parts: str) -> str:
    framed = " || ".join(f"length(({p})::VARCHAR)::VARCHAR || ':' || ({p})::VARCHAR" for p in parts)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat_ws('-', " + ", ".join(f"substr(md5({framed}), {a}, {n})" for a, n in cuts) + ")"


def _risk(score: str) -> str:
    return f"CASE WHEN {score} > 0.6 THEN 'critical' WHEN {score} > 0.3 THEN 'elevated' ELSE 'stable' END"


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def _two_digits(score: str) -> str:
    # Exact halves go up; the other values are far enough from a half for any rounding.
    return f"format('{{:.2f}}', {score} + CASE WHEN {score} IN (0.125, 0.375, 0.625, 0.875) THEN 0.001 ELSE 0 END)"


def _bursts(threshold: int) -> str:
    return f"""
        SELECT {_uuid("'burst'", "topic_key", "window_start", "window_end")} AS event_id, topic_name, platform,
               volume AS article_count, avg_bias_score, trend_direction, window_start, window_end,
               window_end AS detection_timestamp
        FROM directed WHERE volume > {threshold}"""


def _kind(field: str, document: str = "value") -> str:
    return f"json_type({document}, '$.{field}')"


def _text(field: str, document: str = "value") -> str:
    return f"CASE WHEN {_kind(field, document)} = 'VARCHAR' THEN json_extract_string({document}, '$.{field}') END"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{SCRIPT_SPACE}+|{SCRIPT_SPACE}+$', '', 'g')"


def _truthy(field: str) -> str:
    return (
        f"({_kind(field)} IS NOT NULL AND {_kind(field)} <> 'NULL'"
        f" AND NOT ({_kind(field)} = 'VARCHAR' AND json_extract_string(value, '$.{field}') = ''))"
    )


def _latest(table: str, time: str, key: str) -> str:
    return f"""
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY topic_name, platform ORDER BY {time} DESC, {key} DESC) AS rn
            FROM {table}
        ) WHERE rn = 1"""


def _trending(bursts: str, forecasts: str) -> str:
    return f"""
        SELECT topic_name, platform, article_count::BIGINT AS volume, avg_bias_score, trend_direction,
               {_risk("avg_bias_score")} AS risk_level, detection_timestamp AS updated_at
        FROM ({_latest(bursts, "detection_timestamp", "event_id")})
        UNION ALL
        SELECT topic_name, platform, round_even(predicted_volume, 0)::BIGINT AS volume, avg_bias_score,
               trend_direction, {_risk("avg_bias_score")} AS risk_level, created_at AS updated_at
        FROM ({_latest(forecasts, "created_at", "forecast_id")}) AS f
        WHERE NOT EXISTS (
            SELECT 1 FROM {bursts} AS b WHERE b.topic_name = f.topic_name AND b.platform = f.platform
        )"""


_SCORES_ROUNDED = "round(avg_bias_score, 10) AS avg_bias_score"

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "analyzed": (
        (),
        """
        SELECT event_id::VARCHAR AS "articleId", event_type AS title, 'src' || (user_id % 4)::VARCHAR AS "sourceName",
               ts AS "publishedAt",
               CASE WHEN value >= 5 THEN
                   1 - exp(-value / ((1 + length(event_type) % 4) * (1 + length(event_type) % 4) * 25)) END AS "biasScore",
               value < 5 AS "errorFlag"
        FROM events""",
    ),
    "counted": (
        ("analyzed",),
        """
        SELECT title || '|' || "sourceName" AS topic_key, title AS topic_name, "sourceName" AS platform,
               count(*) AS volume, avg("biasScore") AS avg_bias_score,
               date_trunc('day', "publishedAt")::TIMESTAMP AS window_start,
               date_trunc('day', "publishedAt")::TIMESTAMP + INTERVAL 1 DAY AS window_end
        FROM analyzed GROUP BY ALL""",
    ),
    "directed": (
        ("counted",),
        """
        SELECT *, CASE WHEN volume > previous_volume * 1.05 THEN '↑' WHEN volume < previous_volume * 0.95 THEN '↓'
                       ELSE '→' END AS trend_direction
        FROM (SELECT *, lag(volume) OVER (PARTITION BY topic_key ORDER BY window_start) AS previous_volume FROM counted)
        """,
    ),
    "bursts": (("directed",), _bursts(THRESHOLD)),
    "more_bursts": (("directed",), _bursts(THRESHOLD - 4)),
    "forecasts": (
        ("directed",),
        f"""
        SELECT {_uuid("'forecast'", "topic_key", "window_start", "window_end")} AS forecast_id, topic_name, platform,
               volume::DOUBLE AS predicted_volume, least(1.0::DOUBLE, volume / {THRESHOLD}.0::DOUBLE) AS confidence_score,
               avg_bias_score, trend_direction, window_end + INTERVAL 1 HOUR AS forecast_horizon,
               window_end AS created_at
        FROM directed""",
    ),
    "predictions": (
        ("bursts", "forecasts"),
        f"""
        SELECT 'burst_event' AS type, event_id AS id, topic_name, platform, article_count, avg_bias_score,
               trend_direction, window_start, window_end, detection_timestamp AS created_at,
               NULL::DOUBLE AS predicted_volume, NULL::DOUBLE AS confidence_score, NULL::VARCHAR AS forecast_horizon
        FROM bursts
        UNION ALL
        SELECT 'trend_forecast', forecast_id, topic_name, platform, NULL, avg_bias_score, trend_direction, NULL, NULL,
               created_at, predicted_volume, confidence_score, {_iso("forecast_horizon")}
        FROM forecasts""",
    ),
    "trending": (("bursts", "forecasts"), _trending("bursts", "forecasts")),
    "articles": (
        (),
        """
        SELECT doc_id::VARCHAR AS article_id, 'https://example.org/' || source || '/' || doc_id::VARCHAR AS source_url,
               split_part(text, chr(10), 1) AS title, text AS body, source AS source_name,
               TIMESTAMP '2024-01-01' + to_minutes(n_chars) AS published_at, '1.0' AS schema_version,
               TIMESTAMP '2024-01-01' + to_minutes(n_chars) + INTERVAL 30 MINUTE AS ingested_at
        FROM documents""",
    ),
    "bias_records": (
        ("articles",),
        f"""
        SELECT record_id, article_id, bias_score, {_label("bias_score")} AS bias_label, analysis_timestamp, error_flag
        FROM (
            SELECT article_id || '-1' AS record_id, article_id,
                   CASE WHEN NOT contains(body, '@') THEN {_score("body", DEFAULT_KEYWORDS)} END AS bias_score,
                   published_at + INTERVAL 1 HOUR AS analysis_timestamp, contains(body, '@') AS error_flag
            FROM articles
            UNION ALL
            SELECT article_id || '-2', article_id,
                   CASE WHEN NOT contains(body, '@') THEN {_score("body", SECOND_KEYWORDS)} END,
                   published_at + CASE WHEN article_id::BIGINT % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 30 MINUTE END, contains(body, '@')
            FROM articles
        )""",
    ),
    "scored_articles": (
        ("articles", "bias_records"),
        """
        SELECT a.*, r.bias_score, r.bias_label
        FROM articles AS a
        LEFT JOIN (
            SELECT article_id, bias_score, bias_label FROM (
                SELECT *, row_number() OVER (
                    PARTITION BY article_id ORDER BY analysis_timestamp DESC, record_id DESC) AS rn
                FROM bias_records
            ) WHERE rn = 1
        ) AS r USING (article_id)""",
    ),
    "raw_json": (
        (),
        f"""
        SELECT doc_id, CASE WHEN shape = 10 THEN left(message, length(message) - 1)
                            WHEN shape = 12 THEN message || ' trailing' ELSE message END AS value
        FROM (
            SELECT doc_id, shape, '{{' || concat_ws(',',
                CASE WHEN shape = 2 THEN '"articleId":null'
                     WHEN shape <> 1 THEN '"articleId":' || to_json(pad || doc_id::VARCHAR || pad)::VARCHAR END,
                '"sourceUrl":' || to_json(pad || 'https://example.org/' || doc_id::VARCHAR || pad)::VARCHAR,
                '"title":' || CASE WHEN shape = 3 THEN '5' WHEN shape = 4 THEN to_json(' ' || chr(9) || chr(160))::VARCHAR
                                   ELSE to_json(pad || lang || pad)::VARCHAR END,
                CASE WHEN shape = 8 THEN '"body":""' WHEN shape <> 9 THEN '"body":' || to_json(text)::VARCHAR END,
                CASE WHEN shape <> 5 THEN '"sourceName":' || to_json(pad || source || pad)::VARCHAR END,
                '"publishedAt":' || CASE WHEN shape = 6 THEN '"2024-01-15"' WHEN shape = 7 THEN '"2024-13-15T10:30:00Z"'
                                         ELSE to_json(pad || '2024-01-15T10:30:00.000Z' || pad)::VARCHAR END
            ) || '}}' AS message
            FROM (SELECT *, doc_id % {RAW_SHAPES} AS shape,
                         CASE WHEN doc_id % {RAW_SHAPES} = 11 THEN ' ' || chr(9) || chr(160) || ' ' ELSE '' END AS pad
                  FROM documents)
        )""",
    ),
    "well_formed": (("raw_json",), "SELECT * FROM raw_json WHERE json_valid(value)"),
    "raw_fields": (
        ("well_formed",),
        f"""
        SELECT doc_id,
               CASE WHEN {_kind("articleId")} IS NULL THEN 'new-' || doc_id::VARCHAR ELSE {_trim(_text("articleId"))} END
                   AS "articleId",
               {_trim(_text("sourceUrl"))} AS "sourceUrl", {_trim(_text("title"))} AS title, {_text("body")} AS body,
               {_trim(_text("sourceName"))} AS "sourceName", {_trim(_text("publishedAt"))} AS "publishedAt",
               CASE WHEN {_kind("schemaVersion")} IS NULL THEN '1.0' ELSE {_trim(_text("schemaVersion"))} END
                   AS "schemaVersion"
        FROM well_formed""",
    ),
    "validated": (
        ("raw_fields",),
        """
        SELECT *, CASE
            WHEN coalesce(title, '') = '' THEN 'title'
            WHEN coalesce("sourceName", '') = '' THEN 'sourceName'
            WHEN coalesce("publishedAt", '') = '' THEN 'publishedAt'
            WHEN NOT regexp_matches("publishedAt",
                '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$')
                THEN 'publishedAt format'
            WHEN coalesce("articleId", '') = '' THEN 'articleId'
            WHEN coalesce("sourceUrl", '') = '' THEN 'sourceUrl'
            WHEN body IS NULL THEN 'body'
            WHEN coalesce("schemaVersion", '') = '' THEN 'schemaVersion' END AS error_reason
        FROM raw_fields""",
    ),
    "payloads": (
        (),
        """
        SELECT doc_id, CASE doc_id % 8
            WHEN 0 THEN '[' || item || ',' || item || ']' WHEN 1 THEN '{"articles":[' || item || ']}' WHEN 2 THEN item
            WHEN 3 THEN '[]' WHEN 4 THEN '{"articles":5}' WHEN 5 THEN text WHEN 6 THEN ''
            ELSE '{"articles":[' || item || ',5]}' END AS value
        FROM (SELECT *, '{"title":' || to_json(lang)::VARCHAR || ',"body":' || to_json(text)::VARCHAR || '}' AS item
              FROM documents)""",
    ),
    "burst_json": (
        ("bursts",),
        f"""
        SELECT event_id, '{{"eventId":' || to_json(event_id)::VARCHAR || ',"topicName":' || to_json(topic_name)::VARCHAR
            || ',"platform":' || to_json(platform)::VARCHAR || ',"articleCount":' || article_count::VARCHAR
            || ',"avgBiasScore":' || coalesce(round(avg_bias_score, 10)::VARCHAR, 'null')
            || ',"trendDirection":"' || trend_direction || '","windowStart":"' || {_iso("window_start")}
            || '","windowEnd":"' || {_iso("window_end")} || '","detectionTimestamp":"' || {_iso("detection_timestamp")}
            || '"}}' AS value
        FROM bursts""",
    ),
    "forecast_json": (
        ("forecasts",),
        f"""
        SELECT forecast_id, predicted_volume::BIGINT % 6 AS shape,
            '{{"forecastId":' || to_json(forecast_id)::VARCHAR || ',"topicName":' || to_json(topic_name)::VARCHAR
            || ',"platform":' || to_json(platform)::VARCHAR || ',"predictedVolume":' || predicted_volume::BIGINT::VARCHAR
            || ',"confidenceScore":' || round(confidence_score, 10)::VARCHAR
            || ',"avgBiasScore":' || coalesce(round(avg_bias_score, 10)::VARCHAR, 'null')
            || ',"trendDirection":"' || trend_direction || '","forecastHorizon":"' || {_iso("forecast_horizon")}
            || '"}}' AS value
        FROM forecasts""",
    ),
    "messages": (
        ("analyzed", "burst_json", "forecast_json"),
        """
        SELECT 'a-' || "articleId" AS message_id, 'analyzed-news' AS topic,
               '{"articleId":' || to_json("articleId")::VARCHAR || ',"title":' || to_json(title)::VARCHAR
               || ',"sourceName":' || to_json("sourceName")::VARCHAR || '}' AS value
        FROM analyzed
        UNION ALL SELECT 'b-' || event_id, 'predictions', value FROM burst_json
        UNION ALL
        SELECT 'f-' || forecast_id, 'predictions', CASE shape
            WHEN 0 THEN regexp_replace(value, '"forecastId":"[^"]*",', '')
            WHEN 1 THEN '{"type":"custom",' || substr(value, 2)
            WHEN 2 THEN left(value, length(value) - 1)
            WHEN 3 THEN regexp_replace(value, '"platform":"[^"]*"', '"platform":null')
            ELSE value END
        FROM forecast_json""",
    ),
    "received": (("messages",), "SELECT * FROM messages WHERE json_valid(value)"),
    "tagged": (
        ("received",),
        f"""
        SELECT *, CASE WHEN topic = 'analyzed-news' THEN 'article'
                       WHEN {_truthy("type")} THEN json_extract_string(value, '$.type')
                       WHEN {_truthy("eventId")} THEN 'burst_event'
                       WHEN {_truthy("forecastId")} THEN 'trend_forecast' END AS type
        FROM received""",
    ),
    "deliveries": (
        ("analyzed",),
        """
        SELECT *, "publishedAt" AS arrived_at FROM analyzed
        UNION ALL
        SELECT "articleId", title || ' again', "sourceName", "publishedAt", "biasScore", "errorFlag",
               "publishedAt" + INTERVAL 1 HOUR
        FROM analyzed WHERE "biasScore" > 0.5""",
    ),
    "raw_messages": (
        ("articles",),
        f"""
        SELECT article_id AS "articleId", source_url AS "sourceUrl", title, body, source_name AS "sourceName",
               {_iso("published_at")} AS "publishedAt", schema_version AS "schemaVersion"
        FROM articles""",
    ),
    "updates": (
        ("bursts", "forecasts"),
        f"""
        SELECT event_id AS id, topic_name, platform, article_count::BIGINT AS volume, avg_bias_score, trend_direction,
               {_risk("avg_bias_score")} AS risk_level, detection_timestamp AS updated_at FROM bursts
        UNION ALL
        SELECT forecast_id, topic_name, platform, round_even(predicted_volume, 0)::BIGINT, avg_bias_score,
               trend_direction, {_risk("avg_bias_score")}, created_at FROM forecasts""",
    ),
    "upserted": (
        ("updates",),
        """
        SELECT *, min((updated_at, id)) OVER (PARTITION BY topic_name, platform) AS first_seen,
               row_number() OVER (PARTITION BY topic_name, platform ORDER BY updated_at DESC, id DESC) AS rn
        FROM updates""",
    ),
    "located": (
        (),
        "SELECT event_type AS topic, (user_id % 3)::INTEGER AS part, ts FROM events",
    ),
    "lags": (
        ("located",),
        """
        SELECT group_id, topic, part AS "partition", greatest(count(*) - count(*) FILTER (ts <= read_up_to), 0) AS lag
        FROM located, (VALUES ('live', TIMESTAMP '2024-01-30 12:00:00'), ('nightly', TIMESTAMP '2024-01-25 00:00:00'))
            AS groups(group_id, read_up_to)
        GROUP BY ALL""",
    ),
    "english": (
        ("articles",),
        """SELECT * FROM articles WHERE article_id IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'en')""",
    ),
}


def _with(needed: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _VIEWS[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needed:
        visit(name)
    views = ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in ordered)
    return f"WITH {views}\n{body}" if views else body


def _rounded(table: str, *columns: str, where: str = "", tail: str = "") -> str:
    changed = ", ".join(f"round({c}, 10) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({changed}) FROM {table} {where} {tail}"


def _constraints() -> str:
    def null(table: str, *names: str) -> list[tuple[str, str, str]]:
        return [(table, f"{n} not null", f"{n} IS NULL") for n in names]

    def unit(table: str, name: str) -> tuple[str, str, str]:
        return table, f"{name} in [0,1]", f"{name} < 0 OR {name} > 1"

    def known(table: str) -> tuple[str, str, str]:
        return table, "trend_direction known", "trend_direction NOT IN ('↑', '↓', '→')"

    rules = [
        *null("articles", "article_id", "source_url", "title", "body", "source_name", "published_at", "schema_version", "ingested_at"),
        *null("bias_records", "record_id", "article_id", "analysis_timestamp", "error_flag"),
        unit("bias_records", "bias_score"),
        *null(
            "burst_events", "event_id", "topic_name", "platform", "article_count", "trend_direction", "window_start", "window_end",
            "detection_timestamp",
        ),
        unit("burst_events", "avg_bias_score"),
        known("burst_events"),
        ("burst_events", "article_count positive", "article_count <= 0"),
        ("burst_events", "window_end after window_start", "window_end <= window_start"),
        *null(
            "trend_forecasts", "forecast_id", "topic_name", "platform", "predicted_volume", "confidence_score", "trend_direction",
            "forecast_horizon", "created_at",
        ),
        unit("trend_forecasts", "confidence_score"),
        unit("trend_forecasts", "avg_bias_score"),
        known("trend_forecasts"),
        ("trend_forecasts", "predicted_volume not negative", "predicted_volume < 0"),
    ]
    views = {"burst_events": "bursts", "trend_forecasts": "forecasts"}
    parts = [
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER ({broken}) AS violations"
        f" FROM {views.get(table, table)}"
        for table, rule, broken in rules
    ]
    keys = {"articles": "article_id", "bias_records": "record_id", "burst_events": "event_id", "trend_forecasts": "forecast_id"}
    parts += [
        f"SELECT '{table}', '{key} unique', count(*) FROM"
        f" (SELECT {key} FROM {views.get(table, table)} GROUP BY {key} HAVING count(*) > 1)"
        for table, key in keys.items()
    ]
    parts.append(
        "SELECT 'bias_records', 'article_id references articles', count(*) FROM bias_records"
        " WHERE article_id NOT IN (SELECT article_id FROM articles)"
    )
    return "\nUNION ALL ".join(parts)


def _seeded() -> str:
    bursts = ", ".join(
        f"('e1000000-0000-0000-0000-{n:012d}', '{t[0]}', '{t[1]}', {t[2]}, {t[5]}::DOUBLE, '{t[6]}')"
        for n, t in enumerate(SEED_TOPICS, start=1)
    )
    forecasts = ", ".join(
        f"('f1000000-0000-0000-0000-{n:012d}', '{t[0]}', '{t[1]}', {t[3]}::DOUBLE, {t[5]}::DOUBLE, '{t[6]}')"
        for n, t in enumerate(SEED_TOPICS, start=1)
    )
    return f""",
    all_bursts AS (
        SELECT event_id, topic_name, platform, article_count, avg_bias_score, trend_direction, detection_timestamp
        FROM bursts
        UNION ALL SELECT *, {NOW} - INTERVAL 5 MINUTE FROM (VALUES {bursts})
    ),
    all_forecasts AS (
        SELECT forecast_id, topic_name, platform, predicted_volume, avg_bias_score, trend_direction, created_at
        FROM forecasts
        UNION ALL SELECT *, {NOW} FROM (VALUES {forecasts})
    )
    SELECT * REPLACE ({_SCORES_ROUNDED}) FROM ({_trending("all_bursts", "all_forecasts")})"""


def _seeded_articles() -> str:
    articles = ", ".join(
        f"('a1000000-0000-0000-0000-{n:012d}', 'https://example.com/{slug}', '{title}', '{title}', '{topic[1]}',"
        f" {NOW} - INTERVAL {12 - 2 * n} MINUTE, '1.0', {NOW})"
        for n, ((slug, title), topic) in enumerate(zip(SEED_ARTICLES, SEED_TOPICS, strict=True), start=1)
    )
    records = ", ".join(
        f"('b1000000-0000-0000-0000-{n:012d}', 'a1000000-0000-0000-0000-{n:012d}', {t[5]}::DOUBLE, '{t[7]}', {NOW}, false)"
        for n, t in enumerate(SEED_TOPICS, start=1)
    )
    return f""",
    all_articles AS (SELECT * FROM articles UNION ALL SELECT * FROM (VALUES {articles})),
    all_records AS (
        SELECT record_id, article_id, bias_score, bias_label, analysis_timestamp, error_flag FROM bias_records
        UNION ALL SELECT * FROM (VALUES {records}))
    SELECT a.*, r.bias_score, r.bias_label
    FROM all_articles a LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY analysis_timestamp DESC, record_id DESC) AS rn FROM all_records
    ) r ON r.article_id = a.article_id AND r.rn = 1"""


def _salience() -> str:
    counts = "\nUNION ALL ".join(
        f"SELECT '{w}' AS keyword, count(*) FILTER (is_now AND contains(body, '{w}')) AS current,"
        f" count(*) FILTER (NOT is_now AND contains(body, '{w}')) AS previous FROM recent"
        for w in SECOND_KEYWORDS
    )
    return f""",
    newest AS (SELECT max(published_at) AS t FROM articles),
    recent AS (
        SELECT lower(body) AS body, published_at > t - INTERVAL 7 DAY AS is_now FROM articles, newest
        WHERE published_at > t - INTERVAL 14 DAY
    ),
    changes AS (
        SELECT *, CASE WHEN previous > 0 THEN round((current - previous) * 100.0::DOUBLE / previous, 10) END AS change
        FROM ({counts})
    )
    SELECT *, rank() OVER (ORDER BY change DESC NULLS LAST, keyword)::INTEGER AS rank FROM changes"""


def statements() -> dict[str, str]:
    missing = ", ".join(
        f"CASE WHEN NOT {_truthy(f)} THEN '{f}' END" for f in RAW_FIELDS
    )
    heat = ", ".join(
        f"count(*) FILTER ({cond}) AS {band}_articles"
        for band, cond in (
            ("none", "bias_score IS NULL"),
            ("low", "bias_score < 0.33"),
            ("medium", "bias_score >= 0.33 AND bias_score < 0.67"),
            ("high", "bias_score >= 0.67"),
        )
    )
    levels = "\nUNION ALL ".join(
        f"SELECT '{r}' AS risk_level, count(*) FILTER (risk_level = '{r}') AS topics,"
        f" round(count(*) FILTER (risk_level = '{r}') * 100.0::DOUBLE / count(*), 10) AS percent FROM trending"
        for r in ("critical", "elevated", "stable")
    )
    all_forecast_columns = ("confidence_score", "avg_bias_score")
    return {
        "window_counts": _with(("directed",), _rounded("directed", "avg_bias_score")),
        "sliding_counts": _with(
            ("analyzed",),
            """
            SELECT title || '|' || "sourceName" AS topic_key, title AS topic_name, "sourceName" AS platform,
                   count(*) AS volume, round(avg("biasScore"), 10) AS avg_bias_score, window_start,
                   window_start + INTERVAL 1 DAY AS window_end
            FROM (SELECT *, make_timestamp((epoch_us("publishedAt") // 21600000000 - back) * 21600000000) AS window_start
                  FROM analyzed, range(4) AS shifts(back))
            GROUP BY ALL""",
        ),
        "burst_detection": _with(("bursts",), _rounded("bursts", "avg_bias_score")),
        "trend_forecast": _with(("forecasts",), _rounded("forecasts", *all_forecast_columns)),
        "burst_detection_stream": _with(("bursts",), _rounded("bursts", "avg_bias_score")),
        "trend_forecast_stream": _with(("forecasts",), _rounded("forecasts", *all_forecast_columns)),
        "trend_forecast_quiet": _with(("forecasts",), _rounded("forecasts", *all_forecast_columns)),
        "late_rows": _with(
            ("analyzed",),
            """
            SELECT topic_key, window_start, window_end, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late,
                   count(*) AS arrived
            FROM (
                SELECT *, coalesce(window_end <= max("publishedAt") OVER (
                    ORDER BY wave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY, false) AS late
                FROM (
                    SELECT title || '|' || "sourceName" AS topic_key, "publishedAt",
                           date_trunc('day', "publishedAt")::TIMESTAMP AS window_start,
                           date_trunc('day', "publishedAt")::TIMESTAMP + INTERVAL 1 DAY AS window_end,
                           date_diff('day', TIMESTAMP '2024-01-01', "publishedAt"
                               + to_days(CASE WHEN "articleId"::BIGINT % 50 = 0 THEN 3 ELSE 0 END)) // 11 AS wave
                    FROM analyzed))
            WHERE window_end <= (SELECT max("publishedAt") - INTERVAL 1 DAY FROM analyzed)
            GROUP BY ALL""",
        ),
        "expiring_windows_stream": _with(
            ("analyzed",),
            """
            SELECT *, CASE WHEN volume > previous_volume * 1.05 THEN '↑' WHEN volume < previous_volume * 0.95 THEN '↓'
                           ELSE '→' END AS trend_direction
            FROM (
                SELECT * EXCLUDE (before, ended), CASE WHEN window_start < ended + INTERVAL 6 HOUR THEN before END AS previous_volume
                FROM (SELECT *, lag(volume) OVER w AS before, lag(window_end) OVER w AS ended
                      FROM (SELECT title || '|' || "sourceName" AS topic_key, title AS topic_name, "sourceName" AS platform,
                                   count(*) AS volume, round(avg("biasScore"), 10) AS avg_bias_score,
                                   time_bucket(INTERVAL 6 HOUR, "publishedAt", TIMESTAMP '2024-01-01') AS window_start,
                                   time_bucket(INTERVAL 6 HOUR, "publishedAt", TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS window_end
                            FROM analyzed GROUP BY ALL)
                      WINDOW w AS (PARTITION BY topic_key ORDER BY window_start)))""",
        ),
        "event_times": _with(
            ("analyzed",),
            """
            SELECT "articleId", told AS "publishedAt", told IS NULL AS rejected
            FROM (SELECT "articleId", CASE "articleId"::BIGINT % 6 WHEN 5 THEN NULL
                      ELSE date_trunc('second', "publishedAt")::TIMESTAMP END AS told FROM analyzed)""",
        ),
        "predictions_stream": _with(("predictions",), _rounded("predictions", *all_forecast_columns)),
        "latest_bursts": _with(
            ("bursts",), f"SELECT * REPLACE ({_SCORES_ROUNDED}) FROM ({_latest('bursts', 'detection_timestamp', 'event_id')})"
        ),
        "latest_forecasts": _with(
            ("forecasts",), _rounded(f"({_latest('forecasts', 'created_at', 'forecast_id')})", *all_forecast_columns)
        ),
        "forecasts_without_burst": _with(
            ("bursts", "forecasts"),
            _rounded(
                "forecasts",
                *all_forecast_columns,
                where="WHERE (topic_name, platform) NOT IN (SELECT (topic_name, platform) FROM bursts)",
            ),
        ),
        "trending_topics": _with(("trending",), _rounded("trending", "avg_bias_score")),
        "trending_page": _with(
            ("trending",),
            _rounded("trending", "avg_bias_score", tail="ORDER BY updated_at DESC, topic_name, platform LIMIT 10"),
        ),
        "display_text": _with(
            ("trending",),
            f"""
            SELECT topic_name, platform,
                   CASE WHEN volume >= 1000 THEN format('{{:.1f}}', volume / 1000) || 'K' WHEN volume > 0 THEN volume::VARCHAR
                        ELSE '—' END AS volume_text,
                   CASE WHEN avg_bias_score IS NULL THEN '—' WHEN avg_bias_score >= 0.5 THEN '+' || {_two_digits("avg_bias_score")}
                        ELSE {_two_digits("avg_bias_score")} END AS score_text,
                   upper(risk_level) AS risk_text, trend_direction
            FROM trending""",
        ),
        "seeded_trending": _with(("bursts", "forecasts"), _seeded()).replace(")\n,", "),", 1),
        "seeded_articles": _with(("articles", "bias_records"), _seeded_articles()).replace(")\n,", "),", 1),
        "predictions_union": _with(("predictions",), _rounded("predictions", *all_forecast_columns)),
        "predictions_page": _with(
            ("predictions",),
            _rounded("predictions", *all_forecast_columns, tail="ORDER BY created_at DESC, id LIMIT 50 OFFSET 50"),
        ),
        "forecast_panel": _with(
            ("forecasts",),
            """
            SELECT topic_name AS name, predicted_volume, floor(confidence_score * 100 + 0.5)::INTEGER AS confidence_percent,
                   forecast_horizon, forecast_id FROM forecasts""",
        ),
        "client_articles": _with(
            ("scored_articles",),
            f"""
            SELECT article_id AS "articleId", title, source_name AS "sourceName", {_iso("published_at")} AS "publishedAt",
                   bias_score AS "biasScore" FROM scored_articles""",
        ),
        "client_bursts": _with(
            ("bursts",),
            f"""
            SELECT event_id AS "eventId", topic_name AS "topicName", article_count AS "articleCount",
                   {_iso("window_start")} AS "windowStart", {_iso("window_end")} AS "windowEnd",
                   {_iso("detection_timestamp")} AS "detectionTimestamp" FROM bursts""",
        ),
        "client_forecasts": _with(
            ("forecasts",),
            f"""
            SELECT forecast_id AS "forecastId", topic_name AS "topicName", predicted_volume AS "predictedVolume",
                   round(confidence_score, 10) AS "confidenceScore", {_iso("forecast_horizon")} AS "forecastHorizon"
            FROM forecasts""",
        ),
        "articles_latest_score": _with(("scored_articles",), "SELECT * FROM scored_articles"),
        "articles_latest_score_stream": _with(("scored_articles",), "SELECT * FROM scored_articles"),
        "articles_page_stream": _with(
            ("scored_articles",), "SELECT * FROM scored_articles ORDER BY published_at DESC, article_id LIMIT 20"
        ),
        "articles_page": _with(
            ("scored_articles",), "SELECT * FROM scored_articles ORDER BY published_at DESC, article_id LIMIT 20"
        ),
        "article_by_id": _with(("articles",), "SELECT * FROM articles WHERE article_id = '7'"),
        "articles_after": _with(
            ("articles",),
            """
            SELECT * FROM articles
            WHERE published_at < TIMESTAMP '2024-01-02' OR (published_at = TIMESTAMP '2024-01-02' AND article_id > '5')
            ORDER BY published_at DESC, article_id LIMIT 25""",
        ),
        "deep_page": _with(
            ("analyzed",),
            _rounded("analyzed", '"biasScore"', tail='ORDER BY "publishedAt" DESC, "articleId" LIMIT 100 OFFSET 700'),
        ),
        "bias_records_page": _with(
            ("bias_records",),
            "SELECT * FROM bias_records ORDER BY analysis_timestamp DESC, record_id LIMIT 100 OFFSET 200",
        ),
        "recent_articles": _with(("articles",), "SELECT * FROM articles ORDER BY published_at DESC, article_id LIMIT 200"),
        "recent_bursts": _with(
            ("bursts",), _rounded("bursts", "avg_bias_score", tail="ORDER BY detection_timestamp DESC, event_id LIMIT 20")
        ),
        "recent_forecasts": _with(
            ("forecasts",),
            _rounded("forecasts", *all_forecast_columns, tail="ORDER BY created_at DESC, forecast_id LIMIT 50"),
        ),
        "articles_of_source": _with(("scored_articles",), "SELECT * FROM scored_articles WHERE source_name = 'src1'"),
        "keyword_score": f"""
            SELECT doc_id, score, {_label("score")} AS label, second_score, {_label("second_score")} AS second_label
            FROM (SELECT doc_id, {_score("text", DEFAULT_KEYWORDS)} AS score, {_score("text", SECOND_KEYWORDS)} AS second_score
                  FROM documents)""",
        "model_score": """
            SELECT doc_id, round(score, 10) AS "biasScore",
                   CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.5 THEN 'biased' ELSE 'neutral' END AS "biasLabel",
                   score IS NULL AS "errorFlag"
            FROM (SELECT doc_id, CASE WHEN NOT contains(text, '@') THEN least(1.0::DOUBLE,
                      (length(text) - length(replace(text, 'e', '')))::DOUBLE / length(text) * 5) END AS score
                  FROM documents)""",
        "model_score_stream": """
            SELECT doc_id, round(score, 10) AS "biasScore",
                   CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.5 THEN 'biased' ELSE 'neutral' END AS "biasLabel",
                   score IS NULL AS "errorFlag"
            FROM (SELECT doc_id, CASE WHEN NOT contains(text, '@') THEN least(1.0::DOUBLE,
                      (length(text) - length(replace(text, 'e', '')))::DOUBLE / length(text) * 5) END AS score
                  FROM documents)""",
        "score_range": "SELECT event_id, round(value, 10) AS value FROM events WHERE value BETWEEN 0 AND 1",
        "unwrap_payload": _with(
            ("payloads",),
            f"""
            SELECT doc_id, pos::INTEGER AS pos, parsed_ok,
                   CASE json_type(item) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS item_kind,
                   {_text("title", "item")} AS title, length({_text("body", "item")})::INTEGER AS body_length
            FROM (
                SELECT doc_id, parsed_ok, generate_subscripts(items, 1) - 1 AS pos, unnest(items) AS item
                FROM (
                    SELECT doc_id, json_valid(value) AS parsed_ok,
                           CASE WHEN NOT json_valid(value) THEN [to_json(value)]
                                WHEN json_type(value) = 'ARRAY' THEN json_extract(value, '$[*]')
                                WHEN json_type(value, '$.articles') = 'ARRAY' THEN json_extract(value, '$.articles[*]')
                                ELSE [value::JSON] END AS items
                    FROM payloads
                )
            )""",
        ),
        "enrich_defaults": _with(
            ("well_formed",),
            f"""
            SELECT doc_id, CASE WHEN {_kind("articleId")} = 'NULL' THEN 'null' ELSE 'string' END AS id_kind,
                   CASE WHEN {_kind("articleId")} IS NULL THEN 'new-' || doc_id::VARCHAR ELSE {_text("articleId")} END
                       AS article_id,
                   coalesce({_text("schemaVersion")}, '1.0') AS schema_version
            FROM well_formed""",
        ),
        "validate_raw": _with(("validated",), "SELECT doc_id, error_reason FROM validated"),
        "accepted_raw": _with(("validated",), "SELECT * EXCLUDE (error_reason) FROM validated WHERE error_reason IS NULL"),
        "quarantine": _with(
            ("validated",),
            "SELECT error_reason, count(*) AS rejected FROM validated WHERE error_reason IS NOT NULL GROUP BY ALL",
        ),
        "validate_required": _with(
            ("well_formed",), f"SELECT doc_id, concat_ws(',', {missing}) AS missing FROM well_formed"
        ),
        "malformed_json_filter": _with(("well_formed",), "SELECT doc_id FROM well_formed"),
        "strict_messages": _with(
            ("received",),
            f"""
            SELECT message_id, {_text("articleId")} AS "articleId", {_text("title")} AS title,
                   {_text("sourceName")} AS "sourceName"
            FROM received WHERE list_has_all(['articleId', 'title', 'sourceName'], json_keys(value))""",
        ),
        "constraint_report": _with(("articles", "bias_records", "bursts", "forecasts"), _constraints()),
        "orphan_records": _with(
            ("bias_records", "english"),
            "SELECT * FROM bias_records WHERE article_id NOT IN (SELECT article_id FROM english)",
        ),
        "cascade_records": _with(
            ("bias_records", "english"), "SELECT * FROM bias_records WHERE article_id IN (SELECT article_id FROM english)"
        ),
        "partition_lag": _with(("lags",), "SELECT * FROM lags"),
        "consumer_lag": _with(
            ("lags",),
            """
            SELECT group_id, sum(lag)::BIGINT AS total_lag, sum(lag) > 1000 AS breached,
                   string_agg(topic || '/' || "partition"::VARCHAR || '/' || lag::VARCHAR, ',' ORDER BY topic, "partition")
                       AS partitions
            FROM lags GROUP BY group_id""",
        ),
        "lag_edges": _with(
            ("located",),
            """
            SELECT group_id, topic, part AS "partition",
                   CASE part WHEN 2 THEN 0 WHEN 1 THEN count(*) + 1 ELSE greatest(count(*) - count(*) FILTER (ts <= read_up_to), 0) END AS lag
            FROM located, (VALUES ('live', TIMESTAMP '2024-01-30 12:00:00'), ('nightly', TIMESTAMP '2024-01-25 00:00:00'))
                AS groups(group_id, read_up_to)
            GROUP BY group_id, topic, part""",
        ),
        "lag_history": """
            SELECT wave AS batch_id, 'reader' AS group_id, 'source-0' AS topic, 0 AS partition, wave AS committed,
                   count(*) AS input_rows, 0::BIGINT AS total_lag
            FROM (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts + to_days(CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END)) // 11 AS wave
                  FROM events)
            GROUP BY wave""",
        "tag_messages": _with(("tagged",), "SELECT message_id, topic, type FROM tagged"),
        "normalize_trending": _with(
            ("received",),
            f"""
            SELECT 'trending_topic' AS type, topic_name, platform, volume, round(avg_bias_score, 10) AS avg_bias_score,
                   trend_direction, {_risk("avg_bias_score")} AS risk_level, updated_at
            FROM (
                SELECT json_extract_string(value, '$.topicName') AS topic_name,
                       coalesce(json_extract_string(value, '$.platform'), 'Unknown') AS platform,
                       coalesce(json_extract_string(value, '$.articleCount')::DOUBLE,
                                json_extract_string(value, '$.predictedVolume')::DOUBLE, 0) AS volume,
                       json_extract_string(value, '$.avgBiasScore')::DOUBLE AS avg_bias_score,
                       coalesce(json_extract_string(value, '$.trendDirection'), '→') AS trend_direction,
                       coalesce(json_extract_string(value, '$.detectionTimestamp'), '2024-06-01T00:00:00Z') AS updated_at
                FROM received WHERE topic = 'predictions' AND {_truthy("topicName")}
            )""",
        ),
        "route_messages": _with(
            ("tagged",),
            f"""
            SELECT topic, CASE WHEN type = 'article' OR {_kind("articleId")} IS NOT NULL THEN 'article'
                               WHEN type IN ('burst_event', 'trend_forecast', 'trending_topic') THEN type END AS route,
                   count(*) AS messages
            FROM tagged GROUP BY ALL""",
        ),
        "valid_messages": _with(
            ("received",),
            f"SELECT message_id FROM received WHERE json_type(value) = 'OBJECT' AND {_text('type')} <> ''",
        ),
        "dedup_first": _with(
            ("deliveries",),
            """
            SELECT * EXCLUDE (rn) REPLACE (round("biasScore", 10) AS "biasScore") FROM (
                SELECT *, row_number() OVER (PARTITION BY "articleId" ORDER BY arrived_at, title) AS rn FROM deliveries
            ) WHERE rn = 1""",
        ),
        "dedup_first_stream": _with(
            ("deliveries",),
            """
            SELECT * EXCLUDE (rn) REPLACE (round("biasScore", 10) AS "biasScore") FROM (
                SELECT *, row_number() OVER (PARTITION BY "articleId" ORDER BY arrived_at, title) AS rn FROM deliveries
            ) WHERE rn = 1""",
        ),
        "dedup_within_stream": _with(
            ("deliveries",),
            """SELECT * REPLACE (round("biasScore", 10) AS "biasScore") FROM deliveries WHERE title NOT LIKE '% again'""",
        ),
        "capped_topics": """
            SELECT topic_name, platform, updated_at, id FROM (
                SELECT event_type AS topic_name, 'u' || (user_id % 300)::VARCHAR AS platform, ts AS updated_at, event_id AS id,
                       min((ts, event_id)) OVER k AS first_seen,
                       row_number() OVER (PARTITION BY event_type, user_id % 300 ORDER BY ts DESC, event_id DESC) AS rn
                FROM events WINDOW k AS (PARTITION BY event_type, user_id % 300))
            WHERE rn = 1 ORDER BY first_seen DESC LIMIT 100""",
        "upsert_latest": _with(
            ("upserted",),
            f"""
            SELECT * EXCLUDE (first_seen, rn) REPLACE ({_SCORES_ROUNDED}) FROM upserted WHERE rn = 1
            ORDER BY first_seen DESC LIMIT 100""",
        ),
        "upsert_latest_stream": _with(
            ("upserted",),
            f"SELECT * EXCLUDE (first_seen, rn) REPLACE ({_SCORES_ROUNDED}) FROM upserted WHERE rn = 1",
        ),
        "compacted_upserts": _with(
            ("upserted",),
            f"SELECT * EXCLUDE (first_seen, rn) REPLACE ({_SCORES_ROUNDED}) FROM upserted WHERE rn = 1",
        ),
        "live_tables_stream": _with(
            ("tagged",),
            f"""
            SELECT 'articles' AS name, json_extract_string(value, '$.articleId') AS key FROM tagged WHERE type = 'article'
            UNION ALL
            SELECT 'bursts', json_extract_string(value, '$.eventId') FROM tagged WHERE type = 'burst_event'
            UNION ALL
            SELECT 'forecasts', json_extract_string(value, '$.forecastId') FROM tagged WHERE type = 'trend_forecast'
            UNION ALL
            SELECT 'trending', topic_name || '|' || platform || '|' || volume FROM (
                SELECT json_extract_string(value, '$.topicName') AS topic_name,
                       coalesce(json_extract_string(value, '$.platform'), 'Unknown') AS platform,
                       coalesce(json_extract_string(value, '$.articleCount'),
                                json_extract_string(value, '$.predictedVolume')) AS volume,
                       row_number() OVER (PARTITION BY topic_name, platform ORDER BY message_id DESC) AS rn
                FROM tagged WHERE topic = 'predictions' AND {_truthy("topicName")}
            ) WHERE rn = 1""",
        ),
        "insert_if_absent": _with(
            ("more_bursts",),
            f"SELECT * REPLACE ({_SCORES_ROUNDED}) FROM more_bursts",
        ),
        "prediction_ids": _with(
            ("forecasts",),
            """
            SELECT topic_name, created_at, platform, forecast_id,
                   CASE shape WHEN 0 THEN 'forecast_id is missing' WHEN 1 THEN 'forecast_id is no UUID' WHEN 2 THEN 'forecast_id is missing' END
                       AS error_reason
            FROM (SELECT * REPLACE (CASE shape WHEN 0 THEN ' ' WHEN 1 THEN substr(forecast_id, 1, 30) WHEN 3 THEN forecast_id END AS forecast_id)
                  FROM (SELECT *, predicted_volume::BIGINT % 4 AS shape FROM forecasts))""",
        ),
        "insert_pruned": _with(
            ("deliveries",),
            """
            SELECT * EXCLUDE (rn) REPLACE (round("biasScore", 10) AS "biasScore") FROM (
                SELECT *, row_number() OVER (PARTITION BY "articleId" ORDER BY arrived_at, title) AS rn
                FROM (SELECT * REPLACE (CASE WHEN "articleId"::BIGINT % 97 <> 0 THEN "articleId" END AS "articleId")
                      FROM deliveries WHERE title NOT LIKE '% again')
            ) WHERE rn = 1""",
        ),
        "atomic_write": """
            WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS even FROM documents)
            SELECT moment, name,
                   CASE WHEN moment IN ('first', 'stopped') THEN even WHEN name = 'articles' THEN n ELSE n + even END AS stored,
                   CASE WHEN moment IN ('first', 'stopped') THEN even ELSE n END AS article_ids
            FROM n, (SELECT unnest(['first', 'stopped', 'replayed', 'again']) AS moment),
                 (SELECT unnest(['articles', 'records']) AS name)""",
        "dual_write": _with(
            ("articles",),
            f"""
            SELECT article_id, source_name, published_at, 3::BIGINT AS records,
                   {_score("body", SECOND_KEYWORDS)} AS bias_score FROM articles""",
        ),
        "audit_rows": f"""
            SELECT {_uuid("user_id", "event_type", "event_id", "delivery")} AS log_id, user_id::VARCHAR AS session_id, event_type,
                   '{{"articleId":"' || event_id::VARCHAR || '"}}' AS payload, {NOW} AS delivered_at
            FROM (SELECT *, unnest(range(0, event_id % 2 + 1)) AS delivery FROM events)""",
        "raw_payloads": _with(
            ("raw_messages",),
            """
            SELECT "articleId" AS key, json_object('articleId', "articleId", 'sourceUrl', "sourceUrl", 'title', title,
                'body', body, 'sourceName', "sourceName", 'publishedAt', "publishedAt", 'schemaVersion', "schemaVersion"
            )::VARCHAR AS value FROM raw_messages""",
        ),
        "analyzed_payloads": _with(
            ("raw_messages",),
            f"""
            SELECT json_object('articleId', "articleId", 'sourceUrl', "sourceUrl", 'title', title, 'body', body,
                'sourceName', "sourceName", 'publishedAt', "publishedAt", 'schemaVersion', "schemaVersion",
                'biasScore', score, 'biasLabel', {_label("score")}, 'analysisTimestamp', '2024-06-01T00:00:00Z',
                'errorFlag', score IS NULL)::VARCHAR AS value
            FROM (SELECT *, {_score("body", SECOND_KEYWORDS)} AS score FROM raw_messages)""",
        ),
        "prediction_payloads": _with(
            ("burst_json", "forecast_json"),
            "SELECT value FROM burst_json UNION ALL SELECT value FROM forecast_json",
        ),
        "snapshot_roundtrip": _with(
            ("articles", "bursts", "forecasts"),
            """
            (SELECT 'articles' AS name, article_id AS id FROM articles ORDER BY published_at DESC, article_id LIMIT 50)
            UNION ALL
            (SELECT 'bursts', event_id FROM bursts ORDER BY detection_timestamp DESC, event_id LIMIT 20)
            UNION ALL
            (SELECT 'forecasts', forecast_id FROM forecasts ORDER BY created_at DESC, forecast_id LIMIT 50)""",
        ),
        "heatmap": _with(
            ("scored_articles",), f"SELECT source_name, count(*) AS articles, {heat} FROM scored_articles GROUP BY ALL"
        ),
        "articles_by_source": _with(
            ("scored_articles",),
            f"""
            SELECT source_name, article_id, count(*) OVER (PARTITION BY source_name) AS source_articles,
                   CASE WHEN bias_score IS NULL THEN 'none' WHEN bias_score < 0.33 THEN 'low'
                        WHEN bias_score < 0.67 THEN 'medium' ELSE 'high' END AS colour_band,
                   CASE WHEN bias_score IS NULL THEN 'N/A' ELSE {_two_digits("bias_score")} END AS score
            FROM scored_articles""",
        ),
        "kpi_summary": _with(
            ("trending",),
            """
            SELECT count(*) AS total_topics, count(*) FILTER (risk_level = 'critical') AS critical_topics,
                   count(DISTINCT platform) AS active_platforms, round(avg(avg_bias_score), 10) AS mean_bias_score
            FROM trending""",
        ),
        "risk_distribution": _with(("trending",), levels),
        "velocity_series": _with(
            ("analyzed",),
            """
            SELECT bucket_start, round(value, 10) AS value, articles,
                   coalesce(value = max(value) OVER (), false) AS is_peak
            FROM (
                SELECT make_timestamp(epoch_us("publishedAt") // 14400000000 * 14400000000) AS bucket_start,
                       avg("biasScore") AS value, count(*) AS articles
                FROM analyzed WHERE "publishedAt" > (SELECT max("publishedAt") FROM analyzed) - INTERVAL 7 DAY
                GROUP BY 1
            )""",
        ),
        "keyword_salience_table": _with(
            ("articles",),
            """
            SELECT *, rank() OVER (ORDER BY change DESC NULLS LAST, keyword)::INTEGER AS rank
            FROM (
                SELECT *, CASE WHEN previous > 0 THEN round((current - previous) * 100.0::DOUBLE / previous, 10) END AS change
                FROM (
                    SELECT keyword, count(*) FILTER (is_now AND contains(body, lower(keyword))) AS current,
                           count(*) FILTER (NOT is_now AND contains(body, lower(keyword))) AS previous
                    FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS keyword FROM benchmark),
                         (SELECT lower(body) AS body, published_at > t - INTERVAL 7 DAY AS is_now
                          FROM articles, (SELECT max(published_at) AS t FROM articles) WHERE published_at > t - INTERVAL 14 DAY)
                    WHERE keyword <> '' GROUP BY keyword))""",
        ),
        "keyword_salience": _with(("articles",), _salience()).replace(")\n,", "),", 1),
    }
