"""SQL for the problems that read values of mixed form: the forms as patterns, then one reading of days, times and zones."""

from __future__ import annotations

_MONTH = "jan(?:uary|uari)?|feb(?:ruary|ruari)?|mar(?:ch|s)?|apr(?:il)?|ma[yj]|june?|juni|july?|juli|aug(?:ust|usti)?|sep(?:t|tember)?|o[ck]t(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_WEEKDAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)(?:[a-z]*day)?[.]?,? +)?"
_REST = "((?:[^0-9].*)?)"
#: Forms of a day, and how their groups become year, month (a number, a name, W and a week, or D), day and the rest.
_FORMS = [
    *((rf"^([0-9]{{4}}){s}([0-9]{{1,2}}){s}([0-9]{{1,2}}){_REST}$", r"\1|\2|\3|\4") for s in ("-", "/", "[.]")),
    (rf"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/. ]([0-9]{{4}}|[0-9]{{2}}){_REST}$", r"\3|\2|\1|\4"),
    (rf"^{_WEEKDAY}(?:den +)?([0-9]{{1,2}})(?:st|nd|rd|th|[.])?[ -]+({_MONTH})[.]?,?[ -]+([0-9]{{4}}|[0-9]{{2}}){_REST}$", r"\3|\2|\1|\4"),
    (rf"^{_WEEKDAY}({_MONTH})[.]? +([0-9]{{1,2}})(?:st|nd|rd|th)?,? +([0-9]{{4}}){_REST}$", r"\3|\1|\2|\4"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2}):?([0-9]{2}):?([0-9]{2}(?:[.,][0-9]+)?)((?:[^0-9].*)?)$", r"\1|\2|\3|T\4:\5:\6\7"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2}):?([0-9]{2})((?:[^0-9].*)?)$", r"\1|\2|\3|T\4:\5\6"),
    (rf"^([0-9]{{4}})-?W([0-9]{{2}})-?([0-9]){_REST}$", r"\1|W\2|\3|\4"),
    (rf"^([0-9]{{4}})-([0-9]{{3}}){_REST}$", r"\1|D|\2|\3"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"\1|\2|\3|"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", r"\1|\2|\3|T\4:\5"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", r"\1|\2|\3|T\4:\5:\6"),
]
_SIX = (r"^([0-9]{2})([0-9]{2})([0-9]{2})$", r"\1|\2|\3|")
_ZONES = {0: ("Z", "UT", "UTC", "GMT", "WET"), 60: ("BST", "WEST", "CET", "MEZ"), 120: ("CEST", "MESZ", "EET"), 180: ("EEST",)}
_LETTERS = "|".join(sorted((z for zs in _ZONES.values() for z in zs), key=len, reverse=True))
_TAIL = rf"^(?:(?:T|,? +(?:at +|kl[.]? *)?)([0-9]{{1,2}})[:.]([0-9]{{2}})(?:[:.]([0-9]{{2}})(?:[.,]([0-9]+))?)?(?: ?([ap])[.]?m[.]?)?)?(?: ?({_LETTERS}|[+-][0-9]{{2}}(?::?[0-9]{{2}})?))?(?: ?\[([A-Za-z][A-Za-z0-9_+/-]*)\])?$"


def _q(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def readings(values: str) -> str:
    """CTEs that read the values of ``v`` (value, zone, six and further columns): ``r`` has valid and, if so, micros (UTC)."""
    forms = " ".join(f"WHEN regexp_matches(x, {_q(p)}) THEN regexp_replace(x, {_q(p)}, '{r}', 'i')" for p, r in _FORMS)
    letters = " ".join(f"WHEN upper(z) IN ({', '.join(repr(x) for x in zs)}) THEN {n}" for n, zs in _ZONES.items())
    local = lambda z: f"CASE WHEN ((w AT TIME ZONE {z}) - INTERVAL 1 HOUR) AT TIME ZONE {z} = w THEN (w AT TIME ZONE {z}) - INTERVAL 1 HOUR ELSE w AT TIME ZONE {z} END"
    return f"""v AS ({values}),
x AS (SELECT *, trim(value, chr(32) || chr(9) || chr(13) || chr(10)) AS x FROM v WHERE value IS NOT NULL AND value NOT IN ('', 'NA')),
c AS (SELECT *, CASE WHEN six AND regexp_matches(x, {_q(_SIX[0])}) THEN regexp_replace(x, {_q(_SIX[0])}, '{_SIX[1]}') {forms} END AS canon FROM x),
p AS (SELECT *, CASE WHEN length(split_part(canon, '|', 1)) = 2 THEN '20' ELSE '' END || split_part(canon, '|', 1) AS y, split_part(canon, '|', 2) AS m, split_part(canon, '|', 3) AS d, split_part(canon, '|', 4) AS rest FROM c),
w1 AS (SELECT *, CASE WHEN m LIKE 'W%' OR m LIKE 'w%' THEN CASE WHEN d BETWEEN '1' AND '7' THEN make_date(CAST(y AS BIGINT), 1, 4) - CAST(isodow(make_date(CAST(y AS BIGINT), 1, 4)) - 1 AS INTEGER) + (CAST(substr(m, 2) AS INTEGER) - 1) * 7 + CAST(d AS INTEGER) - 1 END
  WHEN m = 'D' THEN make_date(CAST(y AS BIGINT), 1, 1) + CAST(d AS INTEGER) - 1
  ELSE TRY_CAST(concat(y, '-', lpad(coalesce(CAST((nullif(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec', '', '', '', '', 'maj', '', '', '', '', 'okt'], lower(left(m, 3))), 0) - 1) % 12 + 1 AS VARCHAR), m), 2, '0'), '-', lpad(d, 2, '0')) AS DATE) END AS day0 FROM (SELECT * FROM p WHERE canon IS NOT NULL AND y > '0000')),
w2 AS (SELECT *, CASE WHEN m ILIKE 'W%' AND (isoyear(day0) <> CAST(y AS BIGINT) OR week(day0) <> CAST(substr(m, 2) AS BIGINT)) THEN NULL WHEN m = 'D' AND year(day0) <> CAST(y AS BIGINT) THEN NULL ELSE day0 END AS day,
  regexp_matches(rest, {_q(_TAIL)}) AS timed, CAST(nullif(regexp_extract(rest, {_q(_TAIL)}, 1), '') AS INTEGER) AS h, coalesce(CAST(nullif(regexp_extract(rest, {_q(_TAIL)}, 2), '') AS INTEGER), 0) AS mi, coalesce(CAST(nullif(regexp_extract(rest, {_q(_TAIL)}, 3), '') AS INTEGER), 0) AS s,
  CAST(left(regexp_extract(rest, {_q(_TAIL)}, 4) || '000000', 6) AS BIGINT) AS us, lower(regexp_extract(rest, {_q(_TAIL)}, 5)) AS half, regexp_extract(rest, {_q(_TAIL)}, 6) AS z, regexp_extract(rest, {_q(_TAIL)}, 7) AS region FROM w1),
w3 AS (SELECT *, CASE WHEN half = '' THEN coalesce(h, 0) WHEN h BETWEEN 1 AND 12 THEN h % 12 + 12 * CAST(half = 'p' AS INTEGER) ELSE 99 END AS hour,
  CASE WHEN z = '' THEN NULL {letters} ELSE (CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + coalesce(CAST(nullif(replace(substr(z, 4), ':', ''), '') AS INTEGER), 0)) END AS o FROM w2),
w4 AS (SELECT *, day IS NOT NULL AND timed AND hour <= 23 AND mi <= 59 AND s <= 59 AND abs(coalesce(o, 0)) <= 1080 AND (region = '' OR region IN (SELECT name FROM pg_timezone_names())) AS ok FROM w3),
w5 AS (SELECT *, CASE WHEN ok THEN CAST(day AS TIMESTAMP) + to_hours(CAST(hour AS BIGINT)) + to_minutes(CAST(mi AS BIGINT)) + to_seconds(CAST(s AS DOUBLE)) + to_microseconds(us) END AS w FROM w4),
r1 AS (SELECT * EXCLUDE (x, canon, y, m, d, rest, day0, day, timed, h, mi, s, us, half, z, region, hour, o, ok, w), ok AS valid, CASE WHEN NOT ok THEN NULL WHEN o IS NOT NULL THEN epoch_us(w) - CAST(o AS BIGINT) * 60000000 WHEN region <> '' THEN epoch_us({local('region')}) ELSE epoch_us({local('zone')}) END AS micros FROM w5),
r AS (SELECT * FROM r1 UNION ALL BY NAME SELECT * EXCLUDE (x, canon, y, m, d, rest), FALSE AS valid, NULL AS micros FROM p WHERE (canon IS NULL OR NOT y > '0000') AND NOT regexp_full_match(x, '[0-9]{{10}}([0-9]{{3}})?')
  UNION ALL BY NAME SELECT * EXCLUDE (x), TRUE AS valid, CAST(x AS BIGINT) * CASE WHEN length(x) = 10 THEN 1000000 ELSE 1000 END AS micros FROM x WHERE regexp_full_match(x, '[0-9]{{10}}([0-9]{{3}})?'))"""


_QUANTITY = r"'[ \t\r\n]*[0-9]+([.]0+)?[ \t\r\n]*'"
_MIXED = """SELECT 'example_movement_data' AS src_table, row_id, 'lot_date' AS field, lot_date AS value, 'Europe/London' AS zone, FALSE AS six FROM example_movement_data WHERE NOT regexp_full_match(lot_date, '[0-9]{2}/[0-9]{2}/[0-9]{4}')
UNION ALL SELECT 'example_movement_data', row_id, 'departure_date', departure_date, 'Europe/London', FALSE FROM example_movement_data WHERE NOT regexp_full_match(departure_date, '[0-9]{8}')
UNION ALL SELECT 'sweden', row_id, 'Avfärdsdatum', "Avfärdsdatum", 'Europe/Stockholm', TRUE FROM sweden WHERE NOT regexp_full_match("Avfärdsdatum", '[0-9]{4}-[0-9]{2}-[0-9]{2}')"""
_FIELD = r"(?:\"[^\"]*(?:\"\"[^\"]*)*\"|[^\"\x01]*)"
_RECORDS = f"""l AS (SELECT line_id, replace(raw_line, delim, chr(1)) AS t FROM movement_lines),
f AS (SELECT line_id, t, CASE WHEN t IS NULL THEN 'column_count' WHEN NOT regexp_full_match(t, '(?s){_FIELD}(?:\\x01{_FIELD})*') THEN 'quoting' WHEN length(regexp_replace(t, '"[^"]*"', '', 'g')) - length(replace(regexp_replace(t, '"[^"]*"', '', 'g'), chr(1), '')) + 1 <> 19 THEN 'column_count' END AS fault FROM l),
plain AS (SELECT line_id, fault, CASE WHEN fault IS NULL THEN regexp_extract(t, '(?s)^(?:{_FIELD}\\x01){{4}}({_FIELD})', 1) END AS d, CASE WHEN fault IS NULL THEN regexp_extract(t, '(?s)^(?:{_FIELD}\\x01){{6}}({_FIELD})', 1) END AS q FROM f),
rec AS (SELECT 'movement_lines' AS src_table, line_id AS rec_id, fault, CASE WHEN d LIKE '"%' THEN replace(substr(d, 2, length(d) - 2), '""', '"') ELSE d END AS value, CASE WHEN q LIKE '"%' THEN replace(substr(q, 2, length(q) - 2), '""', '"') ELSE q END AS quantity FROM plain
  UNION ALL SELECT 'example_movement_data', row_id, NULL, departure_date, qty_pigs FROM example_movement_data)"""
_JUDGED = f"""WITH {_RECORDS}, {readings("SELECT *, 'Europe/London' AS zone, FALSE AS six FROM rec")},
bad AS (SELECT src_table, rec_id FROM r WHERE NOT valid),
judged AS (SELECT rec.*, CASE WHEN fault IS NOT NULL THEN fault WHEN b.rec_id IS NOT NULL THEN 'bad_date' WHEN quantity IS NOT NULL AND quantity NOT IN ('', 'NA') AND NOT regexp_full_match(quantity, {_QUANTITY}) THEN 'bad_quantity' END AS reason FROM rec LEFT JOIN bad b ON rec.src_table = b.src_table AND rec.rec_id = b.rec_id)"""
_DAILY = f"""{readings("SELECT row_id, movement_reference, regexp_replace(departure_cph, '[^0-9]', '', 'g') AS cph, CAST(regexp_extract(qty_pigs, '[0-9]+') AS BIGINT) AS pigs, departure_date AS value, 'Europe/London' AS zone, FALSE AS six FROM example_movement_data WHERE length(regexp_replace(departure_cph, '[^0-9]', '', 'g')) = 9 AND regexp_full_match(qty_pigs, " + _QUANTITY + ")")},
u AS (SELECT DISTINCT ON (movement_reference) cph, pigs, CAST(make_timestamp(micros) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS DATE) AS day FROM r WHERE valid ORDER BY movement_reference, row_id),
daily AS (SELECT cph, day, sum(pigs) AS pigs FROM u GROUP BY ALL),
cal AS (SELECT cph, CAST(unnest(generate_series(min(day), max(day) + 29, INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY cph),
t AS (SELECT cal.cph, cal.day, CAST(sum(coalesce(pigs, 0)) OVER (k ROWS 6 PRECEDING) AS BIGINT) AS total_7, CAST(sum(coalesce(pigs, 0)) OVER (k ROWS 29 PRECEDING) AS BIGINT) AS total_30 FROM cal LEFT JOIN daily USING (cph, day) WINDOW k AS (PARTITION BY cal.cph ORDER BY cal.day))"""

ORACLE: dict[str, str] = {
    "p2_found": f"WITH {readings(_MIXED)} SELECT src_table, row_id, field, micros AS utc_micros FROM r WHERE valid",
    "p4_found": f"{_JUDGED} SELECT src_table, rec_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_valid": f"{_JUDGED} SELECT src_table, rec_id, trim(value) AS departure_date, CASE WHEN regexp_full_match(quantity, {_QUANTITY}) THEN CAST(regexp_extract(quantity, '[0-9]+') AS BIGINT) END AS qty_pigs FROM judged WHERE reason IS NULL",
    "p5_found": f"WITH {_DAILY} SELECT cph, CAST(day AS VARCHAR) AS day, total_7, total_30 FROM t WHERE total_7 >= 1000",
}
