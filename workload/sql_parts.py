"""SQL text of the derived logs, shared by the cross-check statements."""

WINDOW = 2048


def events_cte(kind: str, window: int = WINDOW, name: str = "ops") -> str:
    """CTE chain ending in ``name``: one structure type's log derived from events."""
    removed = "(event_type = 'error' OR value < 20)"
    shapes = {
        "m": ("event_type", f"CASE WHEN NOT {removed} THEN CAST(v AS VARCHAR) END", f"CASE WHEN {removed} THEN 'r' ELSE 'a' END"),
        "s": ("event_type", "CAST(NULL AS VARCHAR)", f"CASE WHEN {removed} THEN 'r' ELSE 'a' END"),
        "r": ("''", "CAST(v AS VARCHAR)", "'a'"),
        "c": ("CAST(site AS VARCHAR)", "CAST(subtotal AS VARCHAR)", "'a'"),
        "l": (
            "CASE WHEN event_type = 'error' THEN coalesce(prev, slot) ELSE slot END",
            "CASE WHEN event_type <> 'error' THEN CAST(v AS VARCHAR) END",
            "CASE WHEN event_type = 'error' THEN 'r' ELSE 'a' END",
        ),
    }
    key, data, op = shapes[kind]
    seen = ", ".join(
        f"coalesce(count(CASE WHEN site = {s} THEN 1 END) OVER (PARTITION BY id ORDER BY epoch "
        f"RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n{s}"
        for s in (1, 2, 3)
    )
    lts = ", ".join(f"CASE WHEN site = {s} THEN own ELSE n{s} END" for s in (1, 2, 3))
    prev = ""
    if kind == "l":
        prev = (
            ", last_value(CASE WHEN event_type <> 'error' THEN slot END IGNORE NULLS) OVER (PARTITION BY id, site "
            "ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev"
        )
    return f"""
{name}_ev AS (
  SELECT event_id, CAST(1 + event_id % 3 AS INTEGER) AS site, event_id // {window} AS epoch,
    '{kind}-' || CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id END AS VARCHAR) AS id, epoch_us(ts) // 1000 AS pt, CAST(event_id % 4 AS INTEGER) AS lt,
    CAST(floor(value * 100) AS BIGINT) AS v, event_type, value,
    lpad(CAST(event_id AS VARCHAR), 12, '0') || CAST(1 + event_id % 3 AS VARCHAR) AS slot
  FROM events),
{name}_st AS (
  SELECT *, count(*) OVER (PARTITION BY id, site ORDER BY event_id) AS own, {seen},
    sum(v) OVER (PARTITION BY id, site ORDER BY event_id) AS subtotal{prev}
  FROM {name}_ev),
{name} AS (
  SELECT id, {key} AS key, '{kind}' AS type, {data} AS data, site,
    list_transform([{lts}], lambda x: CAST(x AS BIGINT)) AS lts, pt, lt, {op} AS op, event_id AS seq, epoch
  FROM {name}_st)"""


def frontier_cte(src: str = "ops", name: str = "cur", keys: tuple[str, ...] = ("id", "key")) -> str:
    same = " AND ".join(f"t1.{k} = t2.{k}" for k in keys)
    lte = " AND ".join(f"t1.lts[{s}] <= t2.lts[{s}]" for s in (1, 2, 3))
    return f"""
{name} AS (
  SELECT * FROM {src} t1 WHERE NOT EXISTS (
    SELECT 1 FROM {src} t2 WHERE {same} AND t1.lts <> t2.lts AND {lte}))"""


def with_present(kind: str, select: str, window: int = WINDOW, more: str = "") -> str:
    """``select`` over ``cur``, the present of one structure type."""
    return f"WITH {events_cte(kind, window)}, {frontier_cte()}{', ' + more if more else ''}\n{select}"


def with_log(kind: str, select: str, window: int = WINDOW, more: str = "") -> str:
    return f"WITH {events_cte(kind, window)}{', ' + more if more else ''}\n{select}"


NEWEST = "pt DESC, lt DESC, site, data NULLS LAST, lts"
JSON = "CAST(to_json({}) AS VARCHAR)"

# One statement per conflict view, over ``cur``; nested columns as JSON text.
VIEW_SQL = {
    "register_mvr": ("r", "SELECT id, CAST(to_json(list(data ORDER BY site, data)) AS VARCHAR) AS data FROM cur GROUP BY id"),
    "register_lww": ("r", f"SELECT id, data FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {NEWEST}) rn FROM cur) WHERE rn = 1"),
    "set_aw": ("s", "SELECT DISTINCT id, key AS data FROM cur WHERE op = 'a'"),
    "set_rw": ("s", "SELECT id, key AS data FROM cur GROUP BY id, key HAVING bool_and(op <> 'r')"),
    "set_lww": ("s", f"SELECT id, key AS data FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY {NEWEST}) rn FROM cur) WHERE rn = 1 AND op <> 'r'"),
    "map_aw_mvr": ("m", "SELECT id, key, list(data ORDER BY site, data) AS value FROM cur WHERE op = 'a' GROUP BY id, key"),
    "map_aw_lww": ("m", f"SELECT id, key, data AS value FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY op, {NEWEST}) rn FROM cur) WHERE rn = 1 AND op <> 'r'"),
    "map_rw_mvr": ("m", "SELECT id, key, list(data ORDER BY site, data) AS value FROM cur GROUP BY id, key HAVING bool_and(op <> 'r')"),
    "map_lww": ("m", f"SELECT id, key, data AS value FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY {NEWEST}) rn FROM cur) WHERE rn = 1 AND op <> 'r'"),
    "counter": ("c", "SELECT id, CAST(sum(CAST(data AS BIGINT)) AS BIGINT) AS data FROM cur GROUP BY id"),
    "list": ("l", "SELECT id, key AS pos, data FROM cur WHERE op <> 'r'"),
    "list_unsorted": ("l", "SELECT id, key AS pos, data FROM cur WHERE op <> 'r'"),
    "list_tuple": ("l", "SELECT id, CAST(to_json(list(data ORDER BY key, site, pt DESC, lt DESC)) AS VARCHAR) AS data FROM cur WHERE op <> 'r' GROUP BY id"),
}


def view_sql(name: str) -> tuple[str, str]:
    """(structure type, statement) with the published column names of a view."""
    if name in VIEW_SQL:
        kind, body = VIEW_SQL[name]
        if name.startswith("map"):
            body = f"SELECT id, CAST(to_json({{'key': key, 'value': value}}) AS VARCHAR) AS data FROM ({body}) v"
        return kind, body
    base = name.removesuffix("_tuple")
    kind, body = VIEW_SQL[base]
    if kind == "m":
        item, order = "{'key': key, 'value': value}", "key"
    else:
        item, order = "data", "data"
    return kind, f"SELECT id, CAST(to_json(list({item} ORDER BY {order})) AS VARCHAR) AS data FROM ({body}) v GROUP BY id"
