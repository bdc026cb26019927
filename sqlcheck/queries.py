"""Oracle SQL per registered query (DuckDB; driver tables pre-registered as views)."""

import re

from claimlens import constants as K
from sqlcheck import sqlparts as S

Q: dict[str, str] = {}
W = S.with_fixtures
T = K.DEFAULT_THRESHOLD

# --- scans and text ---------------------------------------------------------
Q["scan_claims"] = W() + ("SELECT * REPLACE (CAST(tgldatang AS VARCHAR) AS tgldatang, "
                          "CAST(tglpulang AS VARCHAR) AS tglpulang) FROM claims")
Q["clean_text"] = W() + "SELECT id, " + ", ".join(f"{S.clean_text(c)} AS {c}" for c in K.TEXT_COLUMNS) + " FROM claims"
Q["null_tokens"] = W() + "SELECT id, " + ", ".join(
    f"{S.null_tokens(c)} AS {c}" for c in K.SCORING_TOKEN_COLUMNS) + " FROM claims"
Q["cbg_split"] = W() + "SELECT id, " + ", ".join(
    f"{S.code_part(S.clean_text('cbg'), p)} AS cbg_{p}" for p in ["CMG", "tipekasus", "spesifikkasus", "severity"]
) + " FROM claims"


def _kds():
    out = []
    for col, keep in K.CODE_PARTS:
        if col == "cbg":
            continue
        for p in keep:
            e = S.code_part(S.clean_text(col), p)
            if col == "kdsa" and p == "severity":
                e = S.kdsa_sev(e)
            out.append(f"{e} AS {col}_{p}")
    return ", ".join(out)


Q["kds_split"] = W() + "SELECT id, " + _kds() + " FROM claims"
_sev = S.code_part(S.clean_text("kdsa"), "severity")
Q["kdsa_severity"] = W() + f"SELECT id, {_sev} AS kdsa_part, {S.kdsa_sev(_sev)} AS kdsa_severity FROM claims"
Q["stay_days"] = W() + f"SELECT id, {S.stay('tgldatang', 'tglpulang')} AS lama_rawat FROM claims"

# --- diagnosis codes ----------------------------------------------------------
_code = S.clean_diag("diag")
Q["clean_diag"] = W() + f"SELECT id, ord, diag, {_code} AS diag_clean FROM diagnoses"
Q["icd_parts"] = W() + f"SELECT id, ord, {S.letter(_code)} AS letter, {S.number(_code)} AS number FROM diagnoses"
Q["icd_chapter"] = W() + (f"SELECT id, ord, {S.chapter(S.letter(_code), f'coalesce({S.number(_code)}, 0)')} AS chapter "
                          "FROM diagnoses")

# --- child tables ---------------------------------------------------------------
Q["diag_dedup"] = W(S.DD) + "SELECT * FROM dd"
Q["diag_primary"] = W(S.DD, S.PRIM) + "SELECT * FROM prim"
Q["diag_secondary"] = W(S.DD, S.SEC) + "SELECT * FROM sec"
Q["diag_prepared"] = W(S.DD, S.PRIM, S.SEC, S.DP) + "SELECT * FROM dp"
Q["proc_count"] = W(S.PC) + "SELECT * FROM pc"

# --- imputation and vocabulary -----------------------------------------------------
_base = [S.MAIN, S.DD, S.PRIM, S.SEC, S.DP, S.DPARTS, S.JD]
Q["fit_modes"] = W(*_base) + " UNION ALL ".join(
    [f"SELECT '{c}' AS name, {S.mode_sql('main', c)} AS mode" for c in K.MODE_COLUMNS]
    + [f"SELECT 'diagfkrtl_letter' AS name, {S.mode_sql('jd', 'diagfkrtl_letter')} AS mode"])
Q["merged_fit"] = W(*_base) + (
    "SELECT 'mode' AS kind, name, mode AS value FROM (" + " UNION ALL ".join(
        [f"SELECT '{c}' AS name, {S.mode_sql('main', c)} AS mode" for c in K.MODE_COLUMNS]
        + [f"SELECT 'diagfkrtl_letter' AS name, {S.mode_sql('jd', 'diagfkrtl_letter')} AS mode"])
    + ") UNION ALL SELECT DISTINCT 'vocabulary', 'typefaskes', typefaskes FROM main WHERE typefaskes IS NOT NULL "
    "UNION ALL SELECT 'median within', n, 'true' FROM (VALUES ('biaya'), ('diagfkrtl_num'), ('diagfkrtl_sekunder_counts')) t(n)")
Q["fit_medians"] = W(*_base) + " UNION ALL ".join(
    [f"SELECT 'biaya' AS name, {S.median_sql('main', 'biaya')} AS median",
     f"SELECT 'diagfkrtl_num' AS name, {S.median_sql('jd', 'diagfkrtl_num')} AS median",
     f"SELECT 'diagfkrtl_sekunder_counts' AS name, {S.median_sql('jd', 'diagfkrtl_sekunder_counts')} AS median"])
Q["impute"] = S.features_with() + ("SELECT m.id, coalesce(m.jenispulang, pm.m_jenispulang) AS jenispulang, "
                                   "coalesce(m.pisat, pm.m_pisat) AS pisat, coalesce(m.biaya, pm.med_biaya) AS biaya "
                                   "FROM main m CROSS JOIN pm")
Q["fit_vocab"] = W(S.MAIN) + ("SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS index "
                              "FROM (SELECT DISTINCT typefaskes AS value FROM main WHERE typefaskes IS NOT NULL)")
Q["features"] = S.features_with() + "SELECT * FROM feat"

# --- quality -----------------------------------------------------------------------
def _validate(name, table, cols):
    c = ", ".join(cols)
    return (f"SELECT '{name}' AS table_name, CAST(sum(n) AS BIGINT) AS num_rows, CAST({len(cols)} AS INTEGER) AS num_cols, "
            f"CAST(sum(n - 1) AS BIGINT) AS duplicate_records FROM (SELECT {c}, count(*) AS n FROM {table} GROUP BY ALL)")


_claim_cols = ["id", "id_peserta", "jenispulang", "jenkel", "pisat", "diagfktp", "biaya", "dati2", "typefaskes",
               "usia", "tgldatang", "tglpulang", "jenispel", "politujuan", "cbg", "kelasrawat", "kdsa", "kdsp",
               "kdsr", "kdsi", "kdsd", "label"]
Q["validate"] = W() + " UNION ALL ".join([
    _validate("claims", "claims", _claim_cols),
    _validate("diagnoses", "diagnoses", ["id", "diag", "levelid"]),
    _validate("procedures", "procedures", ["id", "proc"])])
Q["missing"] = W() + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if c == "biaya" else "") + f") AS BIGINT) AS missing FROM claims"
    for c in _claim_cols) + ") WHERE missing > 0"
Q["duplicates"] = W() + (
    "SELECT 'diagnoses' AS table_name, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_records "
    "FROM (SELECT id, diag, levelid, count(*) AS n FROM diagnoses GROUP BY ALL) "
    "UNION ALL SELECT 'procedures', CAST(coalesce(sum(n - 1), 0) AS BIGINT) "
    "FROM (SELECT id, proc, count(*) AS n FROM procedures GROUP BY ALL)")
Q["label_share"] = W() + ("SELECT label, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
                          "FROM claims WHERE label IS NOT NULL GROUP BY label")

# --- sampling and splits -------------------------------------------------------------
MD5 = "md5(CAST(id AS VARCHAR) || ':42')"
SAMPLE = ("samp AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (ORDER BY " + MD5 + ") AS rk, "
          "count(*) OVER () AS n FROM claims) WHERE rk <= round_even(CAST(0.02 AS DOUBLE) * n, 0))")
Q["sample_exact"] = W(SAMPLE) + "SELECT id, label FROM samp"
Q["sample_children"] = W(SAMPLE) + "SELECT d.* FROM diagnoses d SEMI JOIN samp ON d.id = samp.id"
SPLIT = ("spl AS (SELECT id, label, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + v THEN 'val' ELSE 'train' END AS split "
         "FROM (SELECT *, ceil(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS t, "
         "ceil((CAST(n AS DOUBLE) - ceil(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE))) * CAST(0.25 AS DOUBLE)) AS v "
         "FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY " + MD5 + ") AS rk, "
         "count(*) OVER (PARTITION BY label) AS n FROM feat)))")
Q["split"] = S.features_with(SPLIT) + "SELECT * FROM spl"
TRAIN = "tr AS (SELECT id, label FROM spl WHERE split = 'train')"
Q["eval_subsample"] = S.features_with(SPLIT, TRAIN) + (
    "SELECT id, label FROM (SELECT id, label, row_number() OVER (ORDER BY " + MD5 + ") AS rk FROM tr) WHERE rk <= 10000")
Q["undersample"] = S.features_with(SPLIT, TRAIN) + (
    "SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY " + MD5 + ") AS rk, "
    "count(*) OVER (PARTITION BY label) AS n FROM tr) x, "
    "(SELECT arg_min(label, struct_pack(c := c, l := label)) AS minority, min(c) AS m "
    " FROM (SELECT label, count(*) AS c FROM tr GROUP BY label)) mm "
    "WHERE label = minority OR rk <= floor(m / CAST(" + repr(K.UNDERSAMPLE_RATIO) + " AS DOUBLE))")

# --- metrics ---------------------------------------------------------------------------
def _logit():
    terms = {
        "stay": "CAST(coalesce(lama_rawat, 0) AS BIGINT)",
        "kdsa_flag": "CAST(kdsa_CMG <> '-' AS BIGINT)",
        "kdsp_flag": "CAST(kdsp_spesifikkasus <> '-' AS BIGINT)",
        "sev3": "CAST(cbg_severity = 'III' AS BIGINT)",
    }
    from claimlens.plans.scoring import LOGIT_BIAS, LOGIT_TERMS
    z = f"CAST('{LOGIT_BIAS!r}' AS DECIMAL(10,4))"
    for w, name in LOGIT_TERMS:
        t = terms.get(name, f"CAST({name} AS BIGINT)")
        z = f"({z} + CAST('{w!r}' AS DECIMAL(10,4)) * {t})"
    return f"(1.0 / (1.0 + exp(-CAST({z} AS DOUBLE))))"


LOGIT = _logit()
EV = ("ev AS (SELECT s.split, f.id, f.label, " + LOGIT + " AS score FROM feat f JOIN spl s ON f.id = s.id "
      "WHERE s.split IN ('val', 'test'))")
THR = f"thr AS (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE)), (CAST({T!r} AS DOUBLE))) v(threshold))"
CONF = ("conf AS (SELECT split, threshold, count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn, "
        "count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, "
        "count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, "
        "count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp FROM ev CROSS JOIN thr GROUP BY split, threshold)")
Q["confusion"] = S.features_with(SPLIT, EV, THR, CONF) + "SELECT * FROM conf"


def _r(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


MET = (f"SELECT split, threshold, tn, fp, fn, tp, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, "
       f"{_r('2 * tp', '2 * tp + fp + fn')} AS f1_score, {_r('tn', 'tn + fp')} AS specificity FROM conf")
Q["metrics_by_split"] = S.features_with(SPLIT, EV, THR, CONF) + MET
Q["metrics"] = S.features_with(SPLIT, EV, THR, CONF) + MET + f" WHERE threshold = CAST({T!r} AS DOUBLE)"
PTS = ("pts AS (SELECT split, score AS threshold, pos, neg, "
       "sum(pos) OVER (PARTITION BY split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps, "
       "sum(neg) OVER (PARTITION BY split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps, "
       "sum(pos) OVER (PARTITION BY split) AS P, sum(neg) OVER (PARTITION BY split) AS N "
       "FROM (SELECT split, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg "
       "FROM ev GROUP BY split, score))")
CURVE = S.features_with(SPLIT, EV, PTS)
Q["roc_curve"] = CURVE + (f"SELECT split, threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps, "
                          f"{_r('fps', 'N')} AS fpr, {_r('tps', 'P')} AS tpr FROM pts")
PR = (f"prc AS (SELECT split, threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps, "
      f"{_r('tps', 'tps + fps')} AS precision, CASE WHEN P = 0 THEN 1.0 ELSE tps / P END AS recall FROM pts)")
Q["pr_curve"] = S.features_with(SPLIT, EV, PTS, PR) + "SELECT * FROM prc"
Q["roc_auc"] = CURVE + (
    "SELECT split, CASE WHEN max(P) = 0 OR max(N) = 0 THEN 0.5 ELSE "
    "CAST(sum(CAST(neg AS HUGEINT) * CAST(2 * tps - pos AS HUGEINT)) AS DOUBLE) / "
    "(2.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) END AS roc_auc FROM pts GROUP BY split")
Q["pr_auc"] = CURVE + (
    "SELECT split, sum((rec - prev_rec) * (prec + prev_prec) / 2) AS pr_auc FROM ("
    "SELECT split, CASE WHEN P = 0 THEN 1.0 ELSE tps / P END AS rec, "
    "CASE WHEN tps - pos + fps - neg = 0 THEN 0.0 WHEN P = 0 THEN 1.0 ELSE (tps - pos) / P END AS prev_rec, "
    "tps / (tps + fps) AS prec, "
    "CASE WHEN tps - pos + fps - neg = 0 THEN 1.0 ELSE (tps - pos) / (tps - pos + fps - neg) END AS prev_prec "
    "FROM pts) GROUP BY split")
TGT = "tgt AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in (0.9, 0.5, 0.1, 0.02, 0.01)) + ") v(target_precision))"
Q["tune_threshold"] = S.features_with(SPLIT, EV, PTS, PR, TGT) + (
    "SELECT split, target_precision, arg_max(threshold, struct_pack(r := recall, t := threshold)) AS threshold, "
    "arg_max(precision, struct_pack(r := recall, t := threshold)) AS precision, "
    "arg_max(recall, struct_pack(r := recall, t := threshold)) AS recall "
    "FROM prc CROSS JOIN tgt WHERE precision >= target_precision GROUP BY split, target_precision")

# --- encoding -------------------------------------------------------------------------------
def _onehot(vocab):
    parts = []
    for col, cats in vocab.items():
        lst = ", ".join(f"'{c}'" for c in cats)
        parts.append(f"SELECT id, '{col}_' || {col} AS feature, CAST(1.0 AS DOUBLE) AS value FROM feat WHERE {col} IN ({lst})")
    return " UNION ALL ".join(parts)


Q["onehot"] = S.features_with() + _onehot(K.KNOWN_CAT_VOCAB)
Q["onehot_open"] = S.features_with() + (
    "SELECT f.id, 'typefaskes_' || f.typefaskes AS feature, CAST(1.0 AS DOUBLE) AS value FROM feat f "
    "WHERE f.typefaskes IN (SELECT DISTINCT typefaskes FROM main)")
Q["ordinal"] = S.features_with() + "SELECT id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(coalesce(list_position([{', '.join(repr(v) for v in K.ORDINAL_VOCAB[c])}], {c}) - 1, -1) AS INTEGER) END AS {c}"
    for c in K.ORDINAL_COLUMNS) + " FROM feat"

def _encode_nonzero():
    parts = []
    for col, cats in K.KNOWN_CAT_VOCAB.items():
        lst = ", ".join(f"'{c}'" for c in cats)
        parts.append(f"CAST({col} IN ({lst}) AS INTEGER)")
    parts.append("CAST(typefaskes IN (SELECT typefaskes FROM main) AS INTEGER)")
    for col in K.ORDINAL_COLUMNS:
        lst = ", ".join(repr(v) for v in K.ORDINAL_VOCAB[col])
        parts.append(f"CAST(coalesce(list_position([{lst}], {col}) - 1, -1) <> 0 AS INTEGER)")
    for col in K.NUMERIC_COLUMNS:
        parts.append(f"CAST(coalesce(CAST({col} AS DOUBLE), 0.0) <> 0 AS INTEGER)")
    return " + ".join(parts)


Q["encode"] = S.features_with() + (
    f"SELECT id, label, CAST({736 + 15} + (SELECT count(DISTINCT typefaskes) FROM main) AS INTEGER) AS width, "
    f"CAST({_encode_nonzero()} AS INTEGER) AS nonzero FROM feat")

# --- scoring ----------------------------------------------------------------------------------
def _conf(p):
    t = f"CAST({T!r} AS DOUBLE)"
    return (f"CASE WHEN {p} >= {t} THEN 0.5 + 0.5 * ({p} - {t}) / (1.0 - {t} + CAST(1e-06 AS DOUBLE)) "
            f"ELSE 1.0 - 0.5 * {p} / ({t} + CAST(1e-06 AS DOUBLE)) END")


_tok_cols = set(K.SCORING_TOKEN_COLUMNS)
CLAIMS_P4 = ("claims_p4 AS (SELECT * REPLACE (" + ", ".join(f"{S.null_tokens(c)} AS {c}" for c in K.SCORING_TOKEN_COLUMNS)
             + ") FROM claims)")
MAIN2 = S.MAIN.replace("main AS (", "main2 AS (").replace("FROM claims)", "FROM claims_p4)")
FEAT2 = S.FEAT.replace("feat AS (", "feat2 AS (").replace("FROM main m CROSS JOIN pm", "FROM main2 m CROSS JOIN pm")
Q["score_batch"] = S.features_with(CLAIMS_P4, MAIN2, FEAT2) + (
    f"SELECT id, {LOGIT} AS fraud_probability, CAST({LOGIT} >= CAST({T!r} AS DOUBLE) AS INTEGER) AS is_fraud, "
    f"{_conf(LOGIT)} AS confidence_score FROM feat2")
RAW = ("raw AS (SELECT c.id, coalesce(CAST(c.biaya AS DOUBLE), 0) AS cost, coalesce(" + S.stay("c.tgldatang", "c.tglpulang") + ", 0) AS stay, "
       "coalesce(s.n, 0) AS n2, coalesce(p.n, 0) AS np FROM claims c "
       "LEFT JOIN (SELECT id, count(*) AS n FROM diagnoses WHERE levelid = 2 GROUP BY id) s ON c.id = s.id "
       "LEFT JOIN (SELECT id, count(*) AS n FROM procedures GROUP BY id) p ON c.id = p.id)")
_reasons = ("list_filter([CASE WHEN cost > 10000000 THEN 'high_cost' END, CASE WHEN stay > 10 THEN 'long_stay' END, "
            "CASE WHEN n2 > 4 THEN 'many_secondary_diagnoses' END, "
            "CASE WHEN np > 5 THEN 'many_procedures' END], lambda x: x IS NOT NULL)")
Q["reasons"] = S.features_with(CLAIMS_P4, MAIN2, FEAT2, RAW) + (
    f"SELECT id, CAST({LOGIT} >= CAST({T!r} AS DOUBLE) AS INTEGER) AS is_fraud, array_to_string({_reasons}, ',') AS reasons, "
    f"CAST(len({_reasons}) AS INTEGER) AS n_reasons FROM feat2 JOIN raw USING (id)")

# claims with their children in lists
NESTED = ("nlist AS (SELECT id, CASE id % 5 WHEN 2 THEN [{'d': 'I10', 'l': 2}] WHEN 3 THEN [{'d': diagfktp, 'l': NULL}, {'d': 'I10', 'l': 2}] "
          "WHEN 4 THEN [{'d': 'E11.9', 'l': 1}, {'d': 'I10', 'l': 2}, {'d': 'I11', 'l': 2}, {'d': 'I12', 'l': 2}, {'d': 'I13', 'l': 2}, {'d': 'I13', 'l': 2}] "
          "ELSE [] END AS ds, CASE id % 4 WHEN 2 THEN ['99.04', '88.78'] WHEN 3 THEN ['1', '2', '3', '4', '5', '6'] ELSE [] END AS ps FROM claims)")
ND = ("ndiag AS (SELECT id, coalesce(d.d, '') AS diag, coalesce(d.l, 1) AS levelid, o AS ord FROM "
      "(SELECT id, unnest(ds) AS d, generate_subscripts(ds, 1) AS o FROM nlist))")
NP = "nproc AS (SELECT id, unnest(ps) AS proc FROM nlist)"
NRAW = RAW.replace("raw AS (", "nraw AS (").replace("FROM diagnoses", "FROM ndiag").replace("FROM procedures", "FROM nproc")
Q["nested_claims"] = W(NESTED, ND, NP, NRAW) + (
    "SELECT r.id, CAST(n2 AS INTEGER) AS n_secondary, CAST(np AS INTEGER) AS n_procedures, coalesce(f.diag, '') AS primary_diag "
    "FROM nraw r LEFT JOIN (SELECT id, diag FROM ndiag WHERE levelid = 1) f ON r.id = f.id")


def _nested_ctes():
    out = [NESTED, ND, NP, NRAW, CLAIMS_P4, MAIN2]
    for cte, name in ((S.DD, "dd"), (S.PRIM, "prim"), (S.SEC, "sec"), (S.DP, "dp"), (S.DPARTS, "dparts"), (S.PC, "pc")):
        for old in ("dparts", "prim", "sec", "dd", "dp", "pc"):
            cte = re.sub(rf"\b{old}\b", f"n_{old}", cte)
        out.append(cte.replace("FROM diagnoses", "FROM ndiag").replace("FROM procedures", "FROM nproc"))
    feat = FEAT2.replace("feat2 AS (", "feat3 AS (").replace("LEFT JOIN dparts d", "LEFT JOIN n_dparts d").replace("LEFT JOIN pc ON m.id = pc.id", "LEFT JOIN n_pc pc ON m.id = pc.id")
    return [*out, feat]


Q["score_stream"] = Q["score_batch"]
Q["stream_children"] = Q["score_batch"]
Q["report_sink"] = Q["score_batch"]
Q["scan_csv"] = Q["features"]
Q["raw_child_counts"] = W() + (
    "SELECT c.id, coalesce(s.n, 0) AS n_secondary_raw, coalesce(p.n, 0) AS n_procedures_raw, "
    "CASE WHEN f.id IS NULL THEN '' ELSE f.diag END AS primary_diag FROM claims c "
    "LEFT JOIN (SELECT id, count(*) AS n FROM diagnoses WHERE levelid = 2 GROUP BY id) s ON c.id = s.id "
    "LEFT JOIN (SELECT id, diag FROM (SELECT id, diag, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn "
    "FROM diagnoses WHERE levelid = 1) WHERE rn = 1) f ON c.id = f.id "
    "LEFT JOIN (SELECT id, count(*) AS n FROM procedures GROUP BY id) p ON c.id = p.id")

Q["knn_minority"] = (
    "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 0) "
    "SELECT id, nb_id, CAST(rank AS INTEGER) AS rank, dist FROM (SELECT a.id, b.id AS nb_id, "
    "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist, "
    "row_number() OVER (PARTITION BY a.id ORDER BY sqrt(list_sum(list_transform(list_zip(a.v, b.v), "
    "lambda p: (p[1] - p[2]) * (p[1] - p[2])))), b.id) AS rank "
    "FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 5")

Q["knn_lsh"] = "SELECT 5 * count(*) AS n_links, true AS recall_reached FROM embeddings"

_above = ("list_filter([CASE WHEN cost > 10000000 THEN 'cost Rp ' || format('{:,.2f}', cost) END, "
          "CASE WHEN stay > 10 THEN printf('stay %d days', CAST(stay AS INTEGER)) END, "
          "CASE WHEN n2 > 4 THEN printf('secondary diagnoses %d', CAST(n2 AS INTEGER)) END, "
          "CASE WHEN np > 5 THEN printf('procedures %d', CAST(np AS INTEGER)) END], lambda x: x IS NOT NULL)")
_explain = (f"CASE WHEN {LOGIT} >= CAST({T!r} AS DOUBLE) THEN 'REVIEW' ELSE 'PASS' END || printf(' | score %.1f of 100 | above limit: ', {LOGIT} * 100) || "
            f"CASE WHEN len({_above}) > 0 THEN array_to_string({_above}, '; ') ELSE 'none' END")
Q["explain"] = S.features_with(CLAIMS_P4, MAIN2, FEAT2, RAW) + (
    f"SELECT id, CAST({LOGIT} >= CAST({T!r} AS DOUBLE) AS INTEGER) AS is_fraud, {_explain} AS explanation FROM feat2 JOIN raw USING (id)")
Q["score_nested"] = S.features_with(*_nested_ctes()) + (
    f"SELECT id, CAST({LOGIT} >= CAST({T!r} AS DOUBLE) AS INTEGER) AS is_fraud, {LOGIT} AS fraud_probability, {_conf(LOGIT)} AS confidence_score, "
    f"{_explain} AS explanation FROM feat3 JOIN nraw USING (id)")
Q["sampled_tables"] = W(SAMPLE.replace("samp AS (", "samp10 AS (").replace("0.02", "0.1")) + (
    "SELECT 'claims' AS table_name, count(*) AS n FROM samp10 UNION ALL SELECT 'diagnoses', count(*) FROM diagnoses SEMI JOIN samp10 USING (id) "
    "UNION ALL SELECT 'procedures', count(*) FROM procedures SEMI JOIN samp10 USING (id)")

def _u(salt):
    return (f"(CAST(CAST(('0x' || substr(md5('42:' || CAST(j AS VARCHAR) || ':{salt}'), 1, 13)) AS BIGINT) AS DOUBLE)"
            f" / CAST({1 << 52} AS DOUBLE))")


_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
Q["oversample_embeddings"] = (
    "WITH e AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, "
    "CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label = 0) AS n_maj FROM e), "
    "kk AS (SELECT n_min, 5 AS k, "
    f"CAST(trunc(n_maj * CAST({K.OVERSAMPLE_RATIO!r} AS DOUBLE) - n_min) AS BIGINT) AS n_new FROM cnt), "
    "mino AS (SELECT id, v, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42')) AS brank "
    "FROM e WHERE label = 1), "
    f"nn AS (SELECT a.id, b.id AS nb_id, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS rank "
    "FROM mino a JOIN mino b ON a.id <> b.id), "
    "js AS (SELECT unnest(range(n_new)) AS j, n_min, k FROM kk), "
    f"picks AS (SELECT j, CAST(floor({_u(1)} * n_min) AS BIGINT) + 1 AS brank, "
    f"CAST(floor({_u(2)} * k) AS BIGINT) + 1 AS rank, {_u(3)} AS step FROM js), "
    "syn AS (SELECT -(p.j + 1) AS id, 1 AS label, "
    "list_transform(list_zip(b.v, n.v), lambda x: x[1] + p.step * (x[2] - x[1])) AS v "
    "FROM picks p JOIN mino b ON p.brank = b.brank JOIN nn ON nn.id = b.id AND nn.rank = p.rank "
    "JOIN mino n ON n.id = nn.nb_id) "
    "SELECT id, label, false AS is_synthetic, v[1] AS x_first, v[len(v)] AS x_last, CAST(len(v) AS INTEGER) AS dim FROM e "
    "UNION ALL SELECT id, label, true, v[1], v[len(v)], CAST(len(v) AS INTEGER) FROM syn")

Q["eval_sink"] = S.features_with(SPLIT, EV) + "SELECT split, id, label, score FROM ev"
Q["prep_roundtrip"] = S.features_with() + (
    f"SELECT id, label, CAST({736 + 15} + (SELECT count(DISTINCT typefaskes) FROM main) AS INTEGER) AS width FROM feat")
Q["model_roundtrip"] = S.features_with(SPLIT) + "SELECT id, true AS same FROM spl WHERE split IN ('val', 'test')"
Q["score_roundtrip"] = W() + "SELECT id, true AS same FROM claims"
_N = "nn AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM tr)"
_MORE = (f"oo AS (SELECT n1 + greatest(0, CAST(trunc(n0 * CAST({K.OVERSAMPLE_RATIO!r} AS DOUBLE) - n1) AS BIGINT)) AS n1, n0 FROM nn)")
Q["rebalance"] = S.features_with(SPLIT, TRAIN, _N, _MORE) + (
    f"SELECT 1 AS label, n1 AS n FROM oo UNION ALL SELECT 0, CAST(least(n0, trunc(n1 / CAST({K.UNDERSAMPLE_RATIO!r} AS DOUBLE))) AS BIGINT) FROM oo")
Q["oversample"] = S.features_with(SPLIT, TRAIN, _N, _MORE) + (
    f"SELECT id, label, false AS is_synthetic, CAST({736 + 15} + (SELECT count(DISTINCT typefaskes) FROM main) AS INTEGER) AS width FROM tr UNION ALL "
    f"SELECT -(j + 1), 1, true, CAST({736 + 15} + (SELECT count(DISTINCT typefaskes) FROM main) AS INTEGER) "
    "FROM (SELECT unnest(range((SELECT oo.n1 FROM oo) - (SELECT nn.n1 FROM nn))) AS j)")

# --- overview -----------------------------------------------------------------------------------
Q["overview_demographics"] = S.features_with() + (
    "SELECT jenkel, kelasrawat, count(*) AS claims, CAST(sum(label) AS BIGINT) AS frauds, avg(biaya) AS avg_cost, "
    "avg(lama_rawat) AS avg_stay FROM feat GROUP BY jenkel, kelasrawat")
Q["overview_cost"] = S.features_with(
    "band AS (SELECT CAST(floor(usia / 10) * 10 AS INTEGER) AS age_band, biaya FROM feat)",
    "bmed AS (SELECT age_band, (min(biaya) + max(biaya)) / 2 AS median_cost FROM ("
    "SELECT age_band, biaya, row_number() OVER (PARTITION BY age_band ORDER BY biaya) AS rn, "
    "count(*) OVER (PARTITION BY age_band) AS n FROM band WHERE biaya IS NOT NULL AND NOT isnan(biaya)) "
    "WHERE rn = (n + 1) // 2 OR rn = n // 2 + 1 GROUP BY age_band)") + (
    "SELECT b.age_band, count(*) AS claims, sum(biaya) AS total_cost, min(biaya) AS min_cost, max(biaya) AS max_cost, "
    "avg(biaya) AS avg_cost, any_value(bmed.median_cost) AS median_cost FROM band b LEFT JOIN bmed ON b.age_band IS NOT DISTINCT FROM bmed.age_band "
    "GROUP BY b.age_band")
Q["overview_imbalance"] = S.features_with() + (
    "SELECT typefaskes, count(*) AS claims, CAST(sum(label) AS BIGINT) AS frauds, sum(label) / count(*) AS fraud_rate "
    "FROM feat GROUP BY typefaskes")


def _rounded():
    from claimlens.queries import ROUND6
    for name, cols in ROUND6.items():
        if name in Q:
            rep = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
            Q[name] = f"SELECT * REPLACE ({rep}) FROM ({Q[name]}) AS q"


_rounded()

# --- scoring and curves over given trees ------------------------------------------------------
def _num(c):
    return f"coalesce(CAST({c} AS DOUBLE), 0.0)"


_TREES = [
    f"(CASE WHEN {_num('biaya')} <= 15000000 THEN -0.375 ELSE 0.625 END)",
    f"(CASE WHEN {_num('lama_rawat')} <= 40 THEN -0.3125 ELSE 0.5 END)",
    f"(CASE WHEN {_num('usia')} <= 48 THEN CASE WHEN {_num('diagfkrtl_sekunder_counts')} <= 2 THEN -0.1875 ELSE 0.125 END "
    f"WHEN {_num('proc_count')} <= 3 THEN 0.0 ELSE 0.34375 END)",
    f"(CASE WHEN {_num('proc_count')} <= 5 THEN -0.125 ELSE 0.25 END)",
]


def _trees_p(n):
    return f"(1.0 / (1.0 + exp(-CAST({' + '.join(_TREES[:n])} AS DOUBLE))))"


_P4 = _trees_p(4)
_SCORED = f"id, {_P4} AS fraud_probability, CAST({_P4} >= CAST({T!r} AS DOUBLE) AS INTEGER) AS is_fraud, {_conf(_P4)} AS confidence_score"
Q["score_batch_model"] = S.features_with(CLAIMS_P4, MAIN2, FEAT2) + f"SELECT {_SCORED} FROM feat2"
Q["score_nested_stream"] = Q["score_nested"]
Q["score_nested_model"] = S.features_with(*_nested_ctes()) + f"SELECT {_SCORED}, {_explain.replace(LOGIT, _P4)} AS explanation FROM feat3 JOIN nraw USING (id)"
Q["score_stream_model"] = Q["score_nested_model"]
Q["csv_report"] = Q["score_batch_model"] + " WHERE id % 97 <> 0 AND id % 89 <> 0 AND id % 83 <> 0"
Q["csv_rejects"] = W() + (
    "SELECT CASE WHEN id % 97 = 0 OR id % 83 = 0 THEN 'unparsable' ELSE 'no id' END AS reason, count(*) AS n, CAST(sum(id_peserta) AS BIGINT) AS members "
    "FROM claims WHERE id % 97 = 0 OR id % 83 = 0 OR id % 89 = 0 GROUP BY 1")
PS = ("ps AS (" + " UNION ALL ".join(
    f"SELECT s.split AS \"set\", f.id, f.label, {n} AS iteration, {_trees_p(n)} AS score FROM feat f JOIN spl s ON f.id = s.id WHERE s.split IN ('train', 'val')"
    for n in (1, 2, 3, 4)) + ")")
Q["partial_scores"] = S.features_with(SPLIT, PS) + "SELECT * FROM ps"
_tp, _fp, _fn = ("count(*) FILTER (WHERE score >= 0.6 AND label = 1)", "count(*) FILTER (WHERE score >= 0.6 AND label <> 1)", "count(*) FILTER (WHERE score < 0.6 AND label = 1)")
Q["learning_curve"] = S.features_with(SPLIT, PS) + (
    f'SELECT "set", iteration, {_tp} / ({_tp} + {_fp} + CAST(1e-10 AS DOUBLE)) AS precision, {_tp} / ({_tp} + {_fn} + CAST(1e-10 AS DOUBLE)) AS recall FROM ps GROUP BY 1, 2')
Q["round_loss"] = S.features_with(SPLIT, PS) + 'SELECT "set", iteration, avg(CASE WHEN label = 1 THEN -ln(score) ELSE -ln(1 - score) END) AS loss FROM ps GROUP BY 1, 2'
Q["round_auc"] = S.features_with(SPLIT, PS) + (
    'SELECT "set", iteration, CASE WHEN P = 0 OR N = 0 THEN 0.5 ELSE (rs - P * (P + 1) / 2.0) / (CAST(P AS DOUBLE) * N) END AS roc_auc FROM ('
    'SELECT "set", iteration, count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label <> 1) AS N, coalesce(sum(r) FILTER (WHERE label = 1), 0) AS rs FROM ('
    'SELECT "set", iteration, label, rank() OVER (PARTITION BY "set", iteration ORDER BY score) + (count(*) OVER (PARTITION BY "set", iteration, score) - 1) / 2.0 AS r '
    'FROM ps) GROUP BY 1, 2)')
Q["diag_primary_kddiag"] = Q["diag_primary"]
Q["stream_dedup"] = Q["score_nested"]
Q["run_store"] = S.features_with(SPLIT, PS) + (
    f'SELECT "set", iteration, \'precision\' AS metric, {_tp} / ({_tp} + {_fp} + CAST(1e-10 AS DOUBLE)) AS value FROM ps GROUP BY 1, 2 UNION ALL '
    f'SELECT "set", iteration, \'recall\', {_tp} / ({_tp} + {_fn} + CAST(1e-10 AS DOUBLE)) FROM ps GROUP BY 1, 2 UNION ALL '
    'SELECT "set", iteration, \'loss\', avg(CASE WHEN label = 1 THEN -ln(score) ELSE -ln(1 - score) END) FROM ps GROUP BY 1, 2')
Q["observed_quality"] = W() + (
    "SELECT 'rows' AS metric, count(*) AS value FROM claims UNION ALL SELECT 'labelled', count(*) FILTER (WHERE label = 1) FROM claims UNION ALL "
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'missing:{c}', count(*) FILTER (WHERE {c} IS NULL) AS n FROM claims" for c in _claim_cols) + ") WHERE n > 0")
_TYPES = dict.fromkeys(_claim_cols, "string") | {"id": "bigint", "id_peserta": "bigint", "biaya": "double", "usia": "int", "kelasrawat": "int", "label": "int",
                                                 "tgldatang": "timestamp_ntz", "tglpulang": "timestamp_ntz"}
Q["quality_report"] = W() + (
    "SELECT (SELECT count(*) FROM claims) AS num_rows, " + f"{len(_claim_cols)} AS num_cols, "
    "(SELECT count(*) FROM claims) - (SELECT count(*) FROM (SELECT DISTINCT * FROM claims)) AS duplicate_records, column_name, missing, data_type FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, '{t}' AS data_type FROM claims" for c, t in _TYPES.items())
    + ") WHERE missing > 0")
