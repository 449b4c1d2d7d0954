"""SQL twins of the queries of the general data problems, for DuckDB."""

from __future__ import annotations

# Packed fields: the quoted and bare alternatives of the grammar as one pattern per kind of cell.
_FIELDS = (("labeled_runs", "run_id", "golden_memory_session_ids"), ("labeled_runs", "run_id", "golden_document_urls"), ("experiment_questions", "question_idx", "evidence_list"), ("experiment_questions", "question_idx", "memory_evidence"))
_CELLS = " UNION ALL ".join(f"SELECT {k} AS record_id, '{f}' AS field_name, {f} AS cell FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY arrived_at) = 1" for t, k, f in _FIELDS)
P6 = rf"""WITH cells AS ({_CELLS}),
  c AS (SELECT record_id, field_name, regexp_replace(cell, '^\s+|\s+$', '', 'g') AS cell FROM cells),
  k AS (SELECT *, starts_with(cell, '[') AS is_list FROM c WHERE cell <> '' AND lower(cell) <> 'nan'),
  p AS (SELECT record_id, field_name, is_list, CASE WHEN is_list THEN regexp_extract_all(cell, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''')
      ELSE list_filter(list_transform(regexp_extract_all(cell, ' *"(?:[^"]|"")*" *|[^|,;\t\r\n]+'), lambda x: trim(x)), lambda x: x <> '') END AS ps FROM k),
  u AS (SELECT record_id, field_name, is_list, i AS pos, ps[i] AS raw FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p))
  SELECT record_id, field_name, pos::INT AS pos, trim(CASE WHEN is_list THEN regexp_replace(substr(raw, 2, len(raw) - 2), '\\(.)', '\1', 'g')
    WHEN starts_with(raw, '"') THEN replace(substr(raw, 2, len(raw) - 2), '""', '"') ELSE raw END) AS item FROM u"""

# Timestamps: (pattern, year, month, day, hour, minute, second, fraction, am/pm, zone, weekday) with 0 for what a pattern lacks.
_OFFSET = r"[+-]\d{2}:?\d{2}"
_CASCADE = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,6}})\d*)?)? ?({_OFFSET}|[A-Za-z]{{1,4}})?(?:\[[A-Za-z0-9_/+-]+\])?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?({_OFFSET}|[Zz])?$", (1, 2, 3, 4, 5, 6, 0, 0, 7, 0)),
    (r"^(\d{4})/(\d{2})/(\d{2}) \(([A-Za-z]{3})\) (\d{2}):(\d{2})$", (1, 2, 3, 5, 6, 0, 0, 0, 0, 4)),
    (r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?$", (1, 2, 3, 4, 5, 6, 0, 0, 0, 0)),
    (r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})(?:,? (\d{1,2}):(\d{2})(?::(\d{2}))?)?(?: ?([AaPp])\.?[Mm]\.?)?$", (3, 1, 2, 4, 5, 6, 0, 7, 0, 0)),
    (rf"^(?:([A-Za-z]{{3}}), )?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))? ({_OFFSET}|[A-Za-z]{{1,4}})$", (4, 3, 2, 5, 6, 7, 0, 0, 8, 1)),
    (rf"^(\p{{L}}{{3,}})\.? (\d{{1,2}}),? (\d{{4}})(?:(?: at|,)? (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))? ?(?:([AaPp])\.?[Mm]\.?)?(?: ({_OFFSET}|[A-Za-z]{{1,4}}))?)?$", (3, 1, 2, 4, 5, 6, 0, 7, 8, 0)),
    (r"^(\d{1,2})(?:\.|er)? (?:de )?(\p{L}{3,})\.?(?: de)? (\d{4})(?:(?:,| à| at| um| a las)? (\d{1,2})[:h](\d{2})(?: Uhr)?)?$", (3, 2, 1, 4, 5, 0, 0, 0, 0, 0)),
]
_NAMES = ("y", "mo", "d", "h", "mi", "s", "us", "ap", "zone", "dow")
_NUMERIC = 4  # the pattern whose date order the source fixes


def _part(i: int) -> str:
    return "CASE " + " ".join(f"WHEN n = {n} THEN {f'regexp_extract(v, {chr(39)}{p}{chr(39)}, {g[i]})' if g[i] else 'NULL'}" for n, (p, g) in enumerate(_CASCADE)) + " END"


# The query's tables of months and zones are not used here: months go by the beginnings of their names, zones by hours.
_BEGIN = ((1, "jan jän ene"), (2, "feb fév fev"), (3, "mar mär maer"), (4, "apr avr abr"), (5, "may mai"), (6, "jun juin"), (7, "jul juil"), (8, "aug aoû aou ago"), (9, "sep set"), (10, "oct okt"), (11, "nov"), (12, "dec dez déc dic"))
_MONTHS = "CASE " + " ".join(f"WHEN regexp_matches(lower(mo), '^({'|'.join(b.split())})') THEN {n}" for n, b in _BEGIN) + " ELSE try_cast(mo AS INT) END"
_HOURS = ((0, "z utc gmt ut wet"), (1, "bst west cet"), (2, "cest eet"), (3, "eest msk"), (5.5, "ist"), (8, "awst"), (9, "jst kst"), (9.5, "acst"), (10, "aest"), (10.5, "acdt"), (11, "aedt"), (12, "nzst"), (13, "nzdt"),
          (-4, "edt"), (-5, "est cdt"), (-6, "cst mdt"), (-7, "mst pdt"), (-8, "pst akdt"), (-9, "akst"), (-10, "hst"))
_ZONES = "CASE " + " ".join(f"WHEN lower(zone) IN ({', '.join(repr(z) for z in names.split())}) THEN {int(h * 60)}" for h, names in _HOURS) + " END"
_LOCAL = "(epoch_us(timezone(tz, to_timestamp({0}))) // 1000000 - {0})"
_EPOCH = "^\\d{10}(\\.\\d{1,6})?$|^\\d{13}$|^\\d{16}$"
_P5 = f"""WITH src AS (SELECT lower(trim(source_name)) AS k, min(tz_name) AS tz, min(date_order) AS ord FROM news_sources GROUP BY 1),
  e AS (SELECT row_id, regexp_replace(published_at, '^\\s+|\\s+$', '', 'g') AS v, tz, ord FROM evidence_items LEFT JOIN src ON k = lower(trim(source))),
  m AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(v, '{p}') THEN {n}" for n, (p, _) in enumerate(_CASCADE))} END AS n FROM e WHERE v <> '' AND NOT regexp_matches(v, '^\\d{{10}}(\\.\\d{{1,6}})?$|^\\d{{13}}$|^\\d{{16}}$')),
  f AS (SELECT row_id, tz, ord, n, {', '.join(f"nullif({_part(i)}, '') AS {name}" for i, name in enumerate(_NAMES))} FROM m WHERE n IS NOT NULL AND (n <> {_NUMERIC} OR ord IN ('dmy', 'mdy'))),
  g AS (SELECT row_id, tz, zone, lower(dow) AS dow, lower(ap) AS ap, try_cast(y AS INT) AS y, CASE WHEN n = {_NUMERIC} AND ord = 'dmy' THEN try_cast(d AS INT) WHEN n = {_NUMERIC} THEN try_cast(mo AS INT) ELSE {_MONTHS} END AS mo,
      CASE WHEN n = {_NUMERIC} AND ord = 'dmy' THEN try_cast(mo AS INT) ELSE try_cast(d AS INT) END AS d, coalesce(h, '0')::INT AS h, coalesce(mi, '0')::INT AS mi, coalesce(s, '0')::INT AS s, rpad(coalesce(us, ''), 6, '0')::BIGINT AS us FROM f),
  t AS (SELECT *, try_cast(y || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS day, CASE WHEN ap IS NOT NULL THEN h % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END ELSE h END AS hh,
      CASE WHEN regexp_matches(zone, '^[+-]') THEN CASE WHEN starts_with(zone, '-') THEN -1 ELSE 1 END * (substr(zone, 2, 2)::INT * 60 + right(zone, 2)::INT) ELSE {_ZONES} END AS off
    FROM g WHERE y BETWEEN 1 AND 9999 AND mi < 60 AND s < 60 AND CASE WHEN ap IS NOT NULL THEN h BETWEEN 1 AND 12 ELSE h < 24 END),
  w AS (SELECT row_id, tz, zone, off, us, epoch(day)::BIGINT + hh * 3600 + mi * 60 + s AS wall FROM t WHERE day IS NOT NULL AND (dow IS NULL OR lower(strftime(day, '%a')) = dow)),
  o AS (SELECT *, wall - {_LOCAL.format('(wall - 86400)')} AS u1, wall - {_LOCAL.format('(wall + 86400)')} AS u2 FROM w WHERE zone IS NULL AND tz IS NOT NULL),
  r AS (SELECT *, {_LOCAL.format('u1')} + u1 = wall AS r1, {_LOCAL.format('u2')} + u2 = wall AS r2 FROM o)"""
P5 = f"""{_P5}
  SELECT row_id, (CASE WHEN len(v) = 16 THEN v::BIGINT WHEN len(v) = 13 THEN v::BIGINT * 1000 ELSE split_part(v, '.', 1)::BIGINT * 1000000 + rpad(split_part(v, '.', 2), 6, '0')::BIGINT END)::BIGINT AS published_us FROM e WHERE regexp_matches(v, '^\\d{{10}}(\\.\\d{{1,6}})?$|^\\d{{13}}$|^\\d{{16}}$')
  UNION ALL SELECT row_id, (wall - off * 60) * 1000000 + us FROM w WHERE zone IS NOT NULL AND off IS NOT NULL
  UNION ALL SELECT row_id, CASE WHEN r1 THEN u1 ELSE u2 END * 1000000 + us FROM r WHERE (r1 OR r2) AND NOT (r1 AND r2 AND u1 <> u2)"""
P5_STATUS = f"""{_P5}, st AS (
    SELECT 'empty' AS instant_status FROM e WHERE v IS NULL OR v = ''
    UNION ALL SELECT 'ok' FROM e WHERE regexp_matches(v, '{_EPOCH}')
    UNION ALL SELECT 'unreadable' FROM m WHERE n IS NULL OR (n = {_NUMERIC} AND ord IS DISTINCT FROM 'dmy' AND ord IS DISTINCT FROM 'mdy')
    UNION ALL SELECT 'impossible' FROM f WHERE row_id NOT IN (SELECT row_id FROM w)
    UNION ALL SELECT CASE WHEN off IS NULL THEN 'unreadable' ELSE 'ok' END FROM w WHERE zone IS NOT NULL
    UNION ALL SELECT 'no_zone' FROM w WHERE zone IS NULL AND tz IS NULL
    UNION ALL SELECT CASE WHEN r1 AND r2 AND u1 <> u2 THEN 'ambiguous' WHEN NOT r1 AND NOT r2 THEN 'nonexistent' ELSE 'ok' END FROM r)
  SELECT instant_status, count(*) AS n_values FROM st GROUP BY 1"""
P6_SPLIT = P6.replace(" ELSE raw END) AS item FROM u", """ ELSE raw END) AS item,
    CASE WHEN NOT is_list AND starts_with(raw, '"') AND NOT regexp_matches(raw, '^"([^"]|"")*"$') THEN 'malformed_quote' END AS error FROM u""")
