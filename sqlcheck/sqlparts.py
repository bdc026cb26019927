"""SQL expression builders (DuckDB dialect) mirroring the operator semantics.

They are written from the rules, not from the Spark code: each takes an SQL
expression string and returns one.
"""

from claimlens import constants as K
from claimlens.sources.fixtures import fixture_ctes

WS = r"'^\s+|\s+$'"


def strip_upper(e: str) -> str:
    return f"upper(regexp_replace(CAST({e} AS VARCHAR), {WS}, '', 'g'))"


def clean_text(e: str) -> str:
    return f"coalesce({strip_upper(e)}, 'NAN')"


def null_tokens(e: str) -> str:
    s = f"regexp_replace(CAST({e} AS VARCHAR), {WS}, '', 'g')"
    toks = ", ".join(f"'{t}'" for t in K.SCORING_MISSING_TOKENS)
    return f"(CASE WHEN {s} IS NULL OR {s} IN ({toks}) THEN 'NAN' ELSE {s} END)"


def clean_diag(e: str) -> str:
    s = clean_text(e)
    f = f"(CASE WHEN {s} = 'H8.14' THEN 'H81.4' WHEN {s} = 'ZO3.9' THEN 'Z03.9' ELSE {s} END)"
    first_digit = f"regexp_matches(substr({f}, 1, 1), '^[0-9]$')"
    pair = f"regexp_matches(substr({f}, 2, 2), '^[0-9][0-9]$')"
    c = (f"(CASE WHEN {f} IN ('H81.4', 'Z03.9') THEN {f} "
         f"WHEN length({f}) >= 3 AND ({first_digit} OR NOT {pair}) THEN 'Z09.8' "
         f"WHEN length({f}) BETWEEN 1 AND 2 AND {first_digit} THEN 'Z09.8' ELSE {f} END)")
    return f"substr({c}, 1, 3)"


def letter(e: str) -> str:
    return f"substr({e}, 1, 1)"


def number(e: str) -> str:
    return f"TRY_CAST(substr({e}, 2) AS INTEGER)"


def chapter(letter_e: str, num_e: str) -> str:
    parts = []
    for ch, letters, lo, hi in reversed(K.ICD10_RULES):
        cond = f"{letter_e} IN ({', '.join(repr(x) for x in letters)})"
        if lo is not None:
            cond += f" AND {num_e} >= {lo}"
        if hi is not None:
            cond += f" AND {num_e} <= {hi}"
        parts.append(f"WHEN {cond} THEN '{ch}'")
    return f"(CASE {' '.join(parts)} ELSE 'XXII' END)"


def code_part(e: str, part: str) -> str:
    arr = f"string_split(coalesce(CAST({e} AS VARCHAR), 'NAN'), '-')"
    n = f"len({arr})"
    four = {"CMG": 1, "tipekasus": 2, "spesifikkasus": 3, "severity": 4}[part]
    three = {"CMG": 1, "tipekasus": None, "spesifikkasus": 2, "severity": 3}[part]
    t3 = f"{arr}[{three}]" if three else "'-'"
    return f"(CASE WHEN {n} = 4 THEN {arr}[{four}] WHEN {n} = 3 THEN {t3} ELSE '-' END)"


def kdsa_sev(e: str) -> str:
    return f"(CASE WHEN {e} IN ('-', 'I', 'II', 'III') THEN {e} ELSE 'III' END)"


def stay(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def mode_sql(table: str, col: str) -> str:
    return (f"(SELECT v FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS c FROM {table} "
            f"WHERE {col} IS NOT NULL GROUP BY 1) ORDER BY c DESC, v LIMIT 1)")


def median_sql(table: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (f"(SELECT (min(x) + max(x)) / 2 FROM (SELECT x, row_number() OVER (ORDER BY x) AS rn, "
            f"count(*) OVER () AS n FROM (SELECT {x} AS x FROM {table} WHERE {col} IS NOT NULL AND NOT isnan({x}))) "
            f"WHERE rn = (n + 1) // 2 OR rn = n // 2 + 1)")


def with_fixtures(*ctes: str) -> str:
    body = ",\n".join([fixture_ctes(), *ctes])
    return f"WITH {body}\n"


# --- the structural pass as CTEs --------------------------------------------
MAIN = ("main AS (SELECT id, id_peserta, jenispulang, pisat, CAST(biaya AS DOUBLE) AS biaya, "
        "CAST(usia AS BIGINT) AS usia, CAST(kelasrawat AS BIGINT) AS kelasrawat, jenispel, dati2, "
        "tgldatang, tglpulang, label, "
        + ", ".join(f"{clean_text(c)} AS {c}" for c in K.TEXT_COLUMNS if c != "politujuan")
        + " FROM claims)")
DD = "dd AS (SELECT id, diag, levelid, min(ord) AS ord FROM diagnoses GROUP BY id, diag, levelid)"
PRIM = ("prim AS (SELECT id, diag FROM (SELECT id, diag, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn "
        "FROM dd WHERE levelid = 1) WHERE rn = 1)")
SEC = "sec AS (SELECT id, count(*) AS diagfkrtl_sekunder_counts FROM dd WHERE levelid = 2 GROUP BY id)"
DP = ("dp AS (SELECT prim.id, " + clean_diag("prim.diag") + " AS diag, "
      "CAST(coalesce(sec.diagfkrtl_sekunder_counts, 0) AS BIGINT) AS diagfkrtl_sekunder_counts "
      "FROM prim LEFT JOIN sec ON prim.id = sec.id)")
DPARTS = ("dparts AS (SELECT id, diagfkrtl_sekunder_counts, " + letter("diag") + " AS diagfkrtl_letter, "
          "CAST(" + number("diag") + " AS DOUBLE) AS diagfkrtl_num FROM dp)")
JD = ("jd AS (SELECT main.id, dparts.diagfkrtl_letter, dparts.diagfkrtl_num, dparts.diagfkrtl_sekunder_counts "
      "FROM main LEFT JOIN dparts ON main.id = dparts.id)")
PC = ("pc AS (SELECT id, count(*) AS proc_count FROM (SELECT DISTINCT id, proc FROM procedures) GROUP BY id)")
PARAMS = ("pm AS (SELECT "
          + ", ".join(f"{mode_sql('main', c)} AS m_{c}" for c in K.MODE_COLUMNS)
          + ", " + median_sql("main", "biaya") + " AS med_biaya"
          + ", " + mode_sql("jd", "diagfkrtl_letter") + " AS m_letter"
          + ", " + median_sql("jd", "diagfkrtl_num") + " AS med_num"
          + ", " + median_sql("jd", "diagfkrtl_sekunder_counts") + " AS med_sec)")


def _parts_select(src: str) -> str:
    out = []
    for col, keep in K.CODE_PARTS:
        for p in keep:
            e = code_part(f"{src}.{col}", p)
            if col == "kdsa" and p == "severity":
                e = kdsa_sev(e)
            out.append(f"{e} AS {col}_{p}")
    return ", ".join(out)


TP = clean_diag("m.diagfktp")
FEAT = ("feat AS (SELECT m.id, m.id_peserta, CAST(coalesce(CAST(m.label AS INTEGER), 0) AS INTEGER) AS label, "
        "coalesce(m.jenispulang, pm.m_jenispulang) AS jenispulang, m.jenkel, "
        "coalesce(m.pisat, pm.m_pisat) AS pisat, coalesce(m.biaya, pm.med_biaya) AS biaya, m.typefaskes, m.usia, "
        "m.jenispel, m.kelasrawat, " + stay("m.tgldatang", "m.tglpulang") + " AS lama_rawat, "
        + _parts_select("m") + ", "
        "CAST(trunc(coalesce(d.diagfkrtl_sekunder_counts, pm.med_sec)) AS BIGINT) AS diagfkrtl_sekunder_counts, "
        + chapter(letter(TP), f"coalesce({number(TP)}, 0)") + " AS diagfktp_icd10, "
        + chapter("coalesce(d.diagfkrtl_letter, pm.m_letter)",
                  "CAST(trunc(coalesce(d.diagfkrtl_num, pm.med_num, 0)) AS BIGINT)") + " AS diagfkrtl_icd10, "
        "CAST(coalesce(pc.proc_count, 0) AS BIGINT) AS proc_count "
        "FROM main m CROSS JOIN pm LEFT JOIN dparts d ON m.id = d.id LEFT JOIN pc ON m.id = pc.id)")

FEATURE_CTES = [MAIN, DD, PRIM, SEC, DP, DPARTS, JD, PC, PARAMS, FEAT]


def features_with(*more: str) -> str:
    return with_fixtures(*FEATURE_CTES, *more)
