"""The scalar rules once more as DuckDB expressions, for the oracle."""

from __future__ import annotations

from ..functions import dates, geo, money, text


def has(x: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in tokens) + ")"


def word(x: str, tokens: tuple[str, ...]) -> str:
    return rf"regexp_matches({x}, '\b(?:{'|'.join(tokens)})\b')"


def low(x: str) -> str:
    return f"lower(trim({x}))"


def clean(x: str) -> str:
    return rf"nullif(trim(regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g')), '')"


def tri_state(x: str) -> str:
    return f"CASE WHEN {word(low(x), text.NO)} THEN FALSE WHEN {word(low(x), text.YES)} THEN TRUE END"


def bedrooms(x: str) -> str:
    return rf"CASE WHEN {has(low(x), text.STUDIO)} THEN 0 WHEN regexp_extract({low(x)}, '(\d+)', 1) <> '' THEN try_cast(regexp_extract({low(x)}, '(\d+)', 1) AS INT) WHEN {has(low(x), text.SHARED)} THEN 1 END"


def furnished(x: str) -> str:
    return f"CASE WHEN {has(low(x), text.PART_FURNISHED)} THEN 'part' WHEN {has(low(x), text.UNFURNISHED)} THEN 'unfurnished' WHEN contains({low(x)}, 'furnished') THEN 'furnished' ELSE 'unknown' END"


def property_type(x: str) -> str:
    kinds = " ".join(f"WHEN contains({low(x)}, '{k}') THEN '{'flat' if k == 'apartment' else k}'" for k in text.PROPERTY_TYPES)
    return f"CASE WHEN {has(low(x), text.SHARED)} THEN 'room' {kinds} END"


def tenancy(x: str) -> str:
    return rf"coalesce(try_cast(nullif(regexp_extract(lower({x}), '(\d+)\s*(?:month|mth|mo)', 1), '') AS INT), try_cast(nullif(regexp_extract(lower({x}), '(\d+)\s*year', 1), '') AS INT) * 12)"


def period(x: str) -> str:
    return f"CASE WHEN {has(f'lower({x})', money.WEEKLY)} THEN 'week' WHEN {has(f'lower({x})', money.MONTHLY)} THEN 'month' ELSE 'unknown' END"


def amount(x: str) -> str:
    return rf"try_cast(nullif(replace(replace(regexp_extract(replace({x}, chr(160), ' '), '£?\s*([0-9][0-9,\s]*(?:\.[0-9]{{1,2}})?)', 1), ',', ''), ' ', ''), '') AS DOUBLE)"


def to_pcm(x: str, default: str) -> str:
    said = f"(CASE WHEN {period(x)} = 'unknown' THEN {default} ELSE {period(x)} END)"
    return f"CAST(round_even(CASE WHEN {said} = 'week' THEN {amount(x)} * 52 / 12 WHEN {said} = 'month' THEN {amount(x)} END, 0) AS INT)"


def reject(x: str, default: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'empty price' WHEN {amount(x)} IS NULL THEN 'no amount' WHEN {period(x)} = 'unknown' AND {default} = 'unknown' THEN 'no period' END"


def outward(x: str) -> str:
    code = f"replace(upper(trim({x})), ' ', '')"
    return f"CASE WHEN regexp_matches({code}, '{geo.OUTWARD}') THEN {code} END"


def from_url(x: str) -> str:
    return outward(f"nullif(regexp_extract(split_part({x}, '?', 1), '{geo.SLUG}', 1), '')")


def postcode(x: str) -> str:
    full = f"regexp_extract({x}, '{geo.POSTCODE}', 1)"
    return f"CASE WHEN {full} <> '' THEN {outward(full)} ELSE {outward(x)} END"


def inward(x: str) -> str:
    return f"nullif(upper(regexp_extract({x}, '{geo.POSTCODE}', 2)), '')"


def address(x: str) -> str:
    tail = f"nullif(regexp_extract(trim({x}), '{geo.TRAILING}', 1), '')"
    return f"coalesce({postcode(x)}, {outward(tail)})"


def _date(y: str, m: str, d: str) -> str:
    return f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"


def _resolve(y: str, m: str, d: str, ref: str) -> str:
    here, then = _date(f"year({ref})", m, d), _date(f"year({ref}) + 1", m, d)
    return f"CASE WHEN {y} IS NOT NULL THEN {_date(y, m, d)} WHEN {here} < {ref} - 31 THEN {then} ELSE {here} END"


def _named(x: str, pattern: str, name: int, day: int, ref: str) -> str:
    months = "[" + ",".join(f"'{m}'" for m in dates.MONTHS) + "]"
    month = lambda h: f"list_position({months}, lower(substr(regexp_extract({h}, '{pattern}', {name}), 1, 3)))"
    hit = f"(list_filter(regexp_extract_all({x}, '{pattern}', 0), lambda h: coalesce({month('h')}, 0) > 0)[1])"
    year = f"try_cast(nullif(regexp_extract({hit}, '{pattern}', 3), '') AS INT)"
    return f"CASE WHEN {hit} IS NOT NULL THEN {_resolve(year, f'CAST({month(hit)} AS INT)', f'try_cast(regexp_extract({hit}, {chr(39)}{pattern}{chr(39)}, {day}) AS INT)', ref)} END"


def iso(x: str) -> str:
    return rf"try_cast(nullif(regexp_extract({x}, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS DATE)"


def day_first(x: str) -> str:
    part = [f"try_cast(nullif(regexp_extract({x}, '{dates.DMY}', {i}), '') AS INT)" for i in (1, 2, 3)]
    return f"CASE WHEN {part[0]} IS NOT NULL THEN {_date(f'(CASE WHEN {part[2]} < 100 THEN {part[2]} + 2000 ELSE {part[2]} END)', part[1], part[0])} END"


def day_month(x: str, ref: str) -> str:
    return _named(x, dates.DAY_MONTH, 2, 1, ref)


def month_day(x: str, ref: str) -> str:
    return _named(x, dates.MONTH_DAY, 1, 2, ref)


def available(x: str, ref: str) -> str:
    read = f"coalesce({iso(x)}, {day_first(x)}, {day_month(x, ref)}, {month_day(x, ref)})"
    return f"CASE WHEN {has(f'lower(trim({x}))', dates.IMMEDIATE)} THEN {ref} WHEN contains(lower({x}), 'tomorrow') THEN {ref} + 1 WHEN {read} BETWEEN {ref} - 365 AND {ref} + 730 THEN {read} END"
