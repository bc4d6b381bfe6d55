"""DuckDB SQL for every registered query (same column names as ``driver_queries``).

Tables are the pre-registered views ``events``, ``orders``, ``lineitem``, ...
These statements are plain whole-table SQL; the rank / position windows below
are the obvious single-node forms that the Spark side reproduces at scale.
"""

from __future__ import annotations

from .driver_queries import (CHUNKS, EVENT_CUTOFF, EVENT_FAMILY, EVENT_LABELS, FOLDS, GOAL, LINE_KEYS,
                             PATIENCE, RARE_PART_TYPES, SCALE_COLS, SEED, SEQ_LEN, SHIP_CUTOFF)

# Number texts, stated here on their own: digits may have single underscores between them.
INT_TEXT = r"^\s*[-+]?\d(_?\d)*\s*$"
NUMBER_TEXT = (r"^\s*[-+]?((\d(_?\d)*\.?|\d(_?\d)*\.\d(_?\d)*|\.\d(_?\d)*)([eE][-+]?\d(_?\d)*)?"
               r"|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])\s*$")
KEYS = ", ".join(LINE_KEYS)
SPLIT = f"CASE WHEN ts < TIMESTAMP '{EVENT_CUTOFF}' THEN 'train' ELSE 'test' END"
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in EVENT_LABELS) + "]"


def rule(scale: str) -> str:
    return f"({LABEL_LIST})[(CAST(floor(value * {scale}) AS INTEGER) % {len(EVENT_LABELS)}) + 1]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sd(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def ratio_exprs(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    tpr = sd(tp, f"{tp} + {fn}")
    ppv = sd(tp, f"{tp} + {fp}")
    return {"tpr": tpr, "tnr": sd(tn, f"{tn} + {fp}"), "ppv": ppv, "npv": sd(tn, f"{tn} + {fn}"),
            "fpr": sd(fp, f"{fp} + {tn}"), "fnr": sd(fn, f"{tp} + {fn}"), "fdr": sd(fp, f"{tp} + {fp}"),
            "acc": sd(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"),
            "f1": sd(f"2 * {ppv} * {tpr}", f"{ppv} + {tpr}")}


RATIOS = ["tpr", "tnr", "ppv", "npv", "fpr", "fnr", "fdr", "acc", "f1"]


def quota_ctes(prefix: str, counts: str, rates) -> tuple[list[str], str]:
    """CTEs turning ``counts(label, n)`` into ``label, n, q0..q{p-1}`` (integer largest remainder)."""
    ctes = [f"{prefix}_s AS (SELECT label, n, CAST(n AS HUGEINT) AS rem FROM {counts})"]
    cur = f"{prefix}_s"
    for i in range(len(rates) - 1):
        rest = f"(1 - {rates[i]!r}::DOUBLE / {sum(rates[i:])!r}::DOUBLE)"
        ctes.append(f"{prefix}_a{i} AS (SELECT *, sum(rem) OVER () AS tot FROM {cur})")
        ctes.append(f"{prefix}_b{i} AS (SELECT *, tot - CAST(ceil({rest} * CAST(tot AS DOUBLE)) AS HUGEINT)"
                    f" AS ntrain FROM {prefix}_a{i})")
        ctes.append(f"{prefix}_c{i} AS (SELECT *, CASE WHEN tot > 0 THEN (rem * ntrain) // tot ELSE 0 END AS fl,"
                    f" CASE WHEN tot > 0 THEN (rem * ntrain) % tot ELSE 0 END AS r FROM {prefix}_b{i})")
        ctes.append(f"{prefix}_d{i} AS (SELECT label, n, rem, CAST(fl + CASE WHEN row_number() OVER (ORDER BY r DESC,"
                    f" coalesce(CAST(label AS VARCHAR), ''), label IS NULL) <= ntrain - sum(fl) OVER () THEN 1 ELSE 0 END"
                    f" AS BIGINT) AS q{i}" + "".join(f", q{j}" for j in range(i)) + f" FROM {prefix}_c{i})")
        ctes.append(f"{prefix}_e{i} AS (SELECT * REPLACE (rem - q{i} AS rem) FROM {prefix}_d{i})")
        cur = f"{prefix}_e{i}"
    last = len(rates) - 1
    ctes.append(f"{prefix} AS (SELECT label, n, " + "".join(f"q{j}, " for j in range(last))
                + f"CAST(rem AS BIGINT) AS q{last} FROM {cur})")
    return ctes, prefix


def part_case(rank: str, names) -> str:
    parts, cum = [], []
    for i, nm in enumerate(names[:-1]):
        cum.append(f"q{i}")
        parts.append(f"WHEN {rank} < {' + '.join(cum)} THEN {q(nm)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(names[-1])} END"


def split_sql(source: str, label: str, key_exprs: list[str], cols: list[str], rates, names,
              split_col: str = "split", where_part: str | None = None, out_cols: list[str] | None = None) -> str:
    """Stratified split of ``source`` in SQL: md5 order inside each class, quotas by largest remainder."""
    h = " || '-' || ".join(f"coalesce(CAST({k} AS VARCHAR), chr(0))" for k in key_exprs) + f" || '-' || {q(str(SEED))}"
    carried = cols + [k for k in key_exprs if k not in cols]
    ctes = [f"sb AS (SELECT {', '.join(carried)}, {label} AS _label, md5({h}) AS _h FROM {source})",
            "sc AS (SELECT _label AS label, count(*) AS n FROM sb GROUP BY _label)"]
    qc, qt = quota_ctes("sq", "sc", rates)
    ctes += qc
    order_keys = ", ".join(key_exprs)
    ctes.append(f"sr AS (SELECT *, row_number() OVER (PARTITION BY _label ORDER BY _h, {order_keys}) - 1 AS _rk FROM sb)")
    ctes.append(f"sp AS (SELECT sr.*, {part_case('_rk', names)} AS {split_col} FROM sr JOIN {qt}"
                f" ON sr._label IS NOT DISTINCT FROM {qt}.label)")
    sel = out_cols or (cols + [split_col])
    body = f"SELECT {', '.join(sel)} FROM sp" + (f" WHERE {where_part}" if where_part else "")
    return "WITH " + ",\n".join(ctes) + "\n" + body


def conf_cte(name: str = "conf") -> str:
    return (f"{name} AS (SELECT {SPLIT} AS split, event_type AS y_true, {rule('1.0')} AS y_pred, count(*) AS n"
            f" FROM events GROUP BY ALL)")


def class_counts_ctes(conf: str = "conf", out: str = "cc") -> list[str]:
    return [
        f"{out}_l AS (SELECT split, y_true AS label FROM {conf} UNION SELECT split, y_pred FROM {conf})",
        f"{out}_r AS (SELECT split, y_true AS label, sum(n) AS support FROM {conf} GROUP BY ALL)",
        f"{out}_c AS (SELECT split, y_pred AS label, sum(n) AS pred_n FROM {conf} GROUP BY ALL)",
        f"{out}_d AS (SELECT split, y_true AS label, sum(n) AS tp FROM {conf} WHERE y_true IS NOT DISTINCT FROM y_pred GROUP BY ALL)",
        f"{out}_t AS (SELECT split, sum(n) AS total FROM {conf} GROUP BY ALL)",
        f"{out} AS (SELECT l.split, l.label, CAST(coalesce(tp, 0) AS BIGINT) AS tp,"
        f" CAST(coalesce(pred_n, 0) - coalesce(tp, 0) AS BIGINT) AS fp,"
        f" CAST(coalesce(support, 0) - coalesce(tp, 0) AS BIGINT) AS fn,"
        f" CAST(total - coalesce(support, 0) - coalesce(pred_n, 0) + coalesce(tp, 0) AS BIGINT) AS tn,"
        f" CAST(coalesce(support, 0) AS BIGINT) AS support"
        f" FROM {out}_l l LEFT JOIN {out}_r r ON l.split = r.split AND l.label IS NOT DISTINCT FROM r.label"
        f" LEFT JOIN {out}_c c ON l.split = c.split AND l.label IS NOT DISTINCT FROM c.label"
        f" LEFT JOIN {out}_d d ON l.split = d.split AND l.label IS NOT DISTINCT FROM d.label"
        f" JOIN {out}_t t ON l.split = t.split)",
    ]


def class_metrics_cte(cc: str = "cc", out: str = "cm") -> str:
    r = ratio_exprs()
    return f"{out} AS (SELECT *, " + ", ".join(f"{r[k]} AS {k}" for k in RATIOS) + f" FROM {cc})"


def rounded_ratios(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{k}, 6) AS {k}" for k in RATIOS)


def average_sql(cm: str = "cm") -> str:
    micro_tpr = sd("sum(tp)", "sum(tp) + sum(fn)")
    micro_ppv = sd("sum(tp)", "sum(tp) + sum(fp)")
    micro = {"tpr": micro_tpr, "tnr": sd("sum(tn)", "sum(tn) + sum(fp)"), "ppv": micro_ppv,
             "npv": sd("sum(tn)", "sum(tn) + sum(fn)"), "fpr": sd("sum(fp)", "sum(fp) + sum(tn)"),
             "fnr": sd("sum(fn)", "sum(tp) + sum(fn)"), "fdr": sd("sum(fp)", "sum(tp) + sum(fp)"),
             "acc": sd("sum(tp)", "sum(support)"), "f1": sd(f"2 * {micro_ppv} * {micro_tpr}", f"{micro_ppv} + {micro_tpr}")}
    parts = [
        "SELECT split, 'micro' AS avg_type, " + ", ".join(f"{micro[k]} AS {k}" for k in RATIOS) + f" FROM {cm} GROUP BY split",
        "SELECT split, 'macro' AS avg_type, " + ", ".join(f"avg({k}) AS {k}" for k in RATIOS) + f" FROM {cm} GROUP BY split",
        "SELECT split, 'weighted' AS avg_type, " + ", ".join(f"{sd(f'sum({k} * support)', 'sum(support)')} AS {k}"
                                                           for k in RATIOS) + f" FROM {cm} GROUP BY split",
    ]
    return "\nUNION ALL\n".join(parts)


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _label_counts() -> str:
    return ("SELECT event_type AS label, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS frac"
            " FROM events GROUP BY event_type")


def _label_counts_union() -> str:
    return ("WITH u AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1"
            " UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1),"
            " m AS (SELECT label, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY label)"
            " SELECT label, n, CAST(n AS DOUBLE) / sum(n) OVER () AS frac FROM m")


def _map_labels() -> str:
    mapping = {k + dot: v for k, v in EVENT_FAMILY.items() for dot in ("", ".")}
    case = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(mapping.items())) + " END"
    return (f"SELECT event_id, label, coalesce({case}, label) AS family FROM (SELECT event_id,"
            f" CASE WHEN value >= 50 THEN event_type || '.' ELSE event_type END AS label FROM events)")


ASCII_CLEAN = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ' +', ' ', 'g')"


def _non_numeric() -> str:
    src = ("SELECT o_orderkey AS id, 'priority' AS src, o_orderpriority AS x FROM orders"
           " UNION ALL SELECT o_orderkey, 'custkey', CAST(o_custkey AS VARCHAR) FROM orders"
           " UNION ALL SELECT event_id, 'props', props FROM events"
           " UNION ALL SELECT event_id, 'value', CAST(value AS VARCHAR) FROM events")
    m = f"regexp_matches(x, {q(NUMBER_TEXT)})"
    return (f"SELECT id, src, x, CASE WHEN {m} THEN TRY_CAST(replace(trim(x), '_', '') AS DOUBLE) END AS num"
            f" FROM ({src}) WHERE x IS NULL OR {m}")


RATIO_SRC = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,"
             " CASE WHEN l_tax = 0 THEN (CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END)"
             " ELSE l_discount / l_tax END AS r1,"
             " CASE WHEN l_discount = 0 THEN '-Infinity'::DOUBLE ELSE l_tax / l_discount END AS r2 FROM lineitem")
VALID = "isfinite(r1) AND isfinite(r2)"


def _cleaning_report() -> str:
    return (f"WITH r AS ({RATIO_SRC}), c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE {VALID}) AS n1,"
            f" count(*) FILTER (WHERE {VALID} AND (l_returnflag IS NULL OR l_returnflag <> 'A')) AS n2 FROM r)"
            " SELECT 'drop_invalid' AS stage, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS removed FROM c"
            " UNION ALL SELECT 'drop_rare', n1, n2, n1 - n2 FROM c")


def _dummy() -> str:
    cols = [f"CAST(coalesce(l_returnflag = {q(v)}, false) AS INTEGER) AS l_returnflag_{v}" for v in ("A", "N", "R")]
    cols += [f"CAST(coalesce(l_linestatus = {q(v)}, false) AS INTEGER) AS l_linestatus_{v}" for v in ("F", "O")]
    return f"SELECT {KEYS}, {', '.join(cols)} FROM lineitem"


CODES = ("codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code"
         " FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL))")


def _scale(kind: str) -> str:
    stats = []
    for i, c in enumerate(SCALE_COLS):
        stats += [f"avg({c}) AS m{i}", f"stddev_pop({c}) AS s{i}", f"min({c}) AS lo{i}", f"max({c}) AS hi{i}"]
    st = f"st AS (SELECT {', '.join(stats)} FROM lineitem WHERE l_shipdate < TIMESTAMP '{SHIP_CUTOFF}')"
    outs = []
    for i, c in enumerate(SCALE_COLS):
        if kind == "standard":
            outs.append(f"round(({c} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END, 6) AS {c}")
        else:
            outs.append(f"round(({c} - lo{i}) / CASE WHEN hi{i} - lo{i} = 0 THEN 1 ELSE hi{i} - lo{i} END, 6) AS {c}")
    return f"WITH {st} SELECT {KEYS}, {', '.join(outs)} FROM lineitem, st"


def _scaler_stats() -> str:
    parts = [f"SELECT {q(c)} AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std_pop,"
             f" min({c}) AS \"min\", max({c}) AS \"max\", count(*) AS n FROM lineitem" for c in SCALE_COLS]
    return " UNION ALL ".join(parts)


def _split_quota() -> str:
    qc, qt = quota_ctes("sq", "sc", [0.6, 0.2, 0.2])
    ctes = ["sc AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)"] + qc
    body = (f"SELECT label, 'train' AS split, q0 AS n FROM {qt} UNION ALL SELECT label, 'val', q1 FROM {qt}"
            f" UNION ALL SELECT label, 'test', q2 FROM {qt}")
    return _with(ctes, body)


POS_EVENTS = "row_number() OVER (ORDER BY ts, event_id) - 1"


def _flow_sequences() -> str:
    return (f"WITH p AS (SELECT event_id, event_type, {POS_EVENTS} AS pos, count(*) OVER () AS n FROM events),"
            f" s AS (SELECT *, pos // {SEQ_LEN} AS seq, pos % {SEQ_LEN} AS step FROM p WHERE pos < {SEQ_LEN} * (n // {SEQ_LEN}))"
            " SELECT seq, count(*) AS n_steps, arg_min(event_id, step) AS first_event_id,"
            " arg_max(event_id, step) AS last_event_id, string_agg(event_type, ',' ORDER BY step) AS labels"
            " FROM s GROUP BY seq")


def _sequence_flatten() -> str:
    return (f"WITH p AS (SELECT event_id, event_type, {POS_EVENTS} AS pos, count(*) OVER () AS n FROM events)"
            f" SELECT pos // {SEQ_LEN} AS seq, pos % {SEQ_LEN} AS step, event_id, event_type FROM p"
            f" WHERE pos < {SEQ_LEN} * (n // {SEQ_LEN})")


def _class_metrics(binary: bool = False) -> str:
    ctes = [conf_cte("conf0")]
    if binary:
        rel = "CASE WHEN regexp_matches({c}, '(?i)view') THEN 'view' ELSE 'attack' END"
        ctes.append(f"conf AS (SELECT split, {rel.format(c='y_true')} AS y_true, {rel.format(c='y_pred')} AS y_pred,"
                    " sum(n) AS n FROM conf0 GROUP BY ALL)")
    else:
        ctes.append("conf AS (SELECT * FROM conf0)")
    ctes += class_counts_ctes()
    ctes.append(class_metrics_cte())
    return _with(ctes, f"SELECT split, label, tp, fp, fn, tn, support, {rounded_ratios()} FROM cm")


def _metrics_base() -> list[str]:
    return [conf_cte("conf"), *class_counts_ctes(), class_metrics_cte()]


def _average_metrics() -> str:
    return _with(_metrics_base() + [f"am AS ({average_sql()})"],
                 f"SELECT split, avg_type, {rounded_ratios()} FROM am")


def _average_table() -> str:
    return _with(_metrics_base() + [f"am AS ({average_sql()})"],
                 "SELECT split, avg_type, round(acc, 6) AS accuracy, round(ppv, 6) AS precision,"
                 " round(tpr, 6) AS recall, round(fpr, 6) AS false_alarm, round(fnr, 6) AS false_negative,"
                 " round(f1, 6) AS f1 FROM am")


def _accuracy_report() -> str:
    body = ("SELECT split, CAST(label AS VARCHAR) AS label, round(ppv, 6) AS precision, round(tpr, 6) AS recall,"
            " round(f1, 6) AS f1, support FROM cm"
            f" UNION ALL SELECT split, 'accuracy', round({sd('sum(tp)', 'sum(support)')}, 6),"
            f" round({sd('sum(tp)', 'sum(support)')}, 6), round({sd('sum(tp)', 'sum(support)')}, 6),"
            " CAST(sum(support) AS BIGINT) FROM cm GROUP BY split"
            " UNION ALL SELECT split, 'macro avg', round(avg(ppv), 6), round(avg(tpr), 6), round(avg(f1), 6),"
            " CAST(sum(support) AS BIGINT) FROM cm GROUP BY split"
            f" UNION ALL SELECT split, 'weighted avg', round({sd('sum(ppv * support)', 'sum(support)')}, 6),"
            f" round({sd('sum(tpr * support)', 'sum(support)')}, 6), round({sd('sum(f1 * support)', 'sum(support)')}, 6),"
            " CAST(sum(support) AS BIGINT) FROM cm GROUP BY split")
    return _with(_metrics_base(), body)


RECON = ("list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - floor(CAST(x AS DOUBLE) * 10) / 10)"
         " * (CAST(x AS DOUBLE) - floor(CAST(x AS DOUBLE) * 10) / 10)))")


ML_SRC = ("SELECT l_linestatus, CAST(l_returnflag = 'A' AS INTEGER) AS y0, CAST(l_returnflag = 'N' AS INTEGER) AS y1,"
          " CAST(l_returnflag = 'R' AS INTEGER) AS y2, CAST(l_discount * 10 > 0.5 AS INTEGER) AS p0,"
          " CAST(l_tax * 12.5 > 0.5 AS INTEGER) AS p1, CAST(l_quantity / 50 > 0.5 AS INTEGER) AS p2 FROM lineitem")


def _multilabel_f1() -> str:
    per = " UNION ALL ".join(
        f"SELECT l_linestatus, {j} AS pos, sum(y{j} * p{j}) AS tp, sum((1 - y{j}) * p{j}) AS fp,"
        f" sum(y{j} * (1 - p{j})) AS fn, sum(y{j}) AS support FROM m GROUP BY l_linestatus" for j in range(3))
    f1 = sd("2 * tp", "2 * tp + fp + fn")
    return (f"WITH m AS ({ML_SRC}), per AS ({per}) SELECT l_linestatus,"
            f" round({sd(f'sum({f1} * support)', 'sum(support)')}, 6) AS weighted_f1 FROM per GROUP BY l_linestatus")


def _exact_match() -> str:
    return (f"WITH m AS ({ML_SRC}) SELECT l_linestatus, round(avg(CAST(p0 = y0 AND p1 = y1 AND p2 = y2 AS DOUBLE)), 6)"
            " AS exact_match FROM m GROUP BY l_linestatus")


FOLD_CTES = [
    f"s AS (SELECT event_type AS y_true, {rule('1.0')} AS y_pred, {rule('3.0')} AS y_pred2,"
    f" {POS_EVENTS} AS pos, count(*) OVER () AS n FROM events)",
    f"f AS (SELECT *, n // {FOLDS} AS base, n % {FOLDS} AS extra FROM s)",
    "g AS (SELECT *, CAST(CASE WHEN pos < extra * (base + 1) THEN pos // (base + 1)"
    " ELSE extra + (pos - extra * (base + 1)) // base END + 1 AS INTEGER) AS fold FROM f)",
    "fa AS (SELECT fold, avg(CAST(y_pred IS NOT DISTINCT FROM y_true AS DOUBLE)) AS acc1,"
    " avg(CAST(y_pred2 IS NOT DISTINCT FROM y_true AS DOUBLE)) AS acc2 FROM g GROUP BY fold)",
]


def _ttest() -> str:
    ctes = FOLD_CTES + [
        "st AS (SELECT count(acc1) AS n1, count(acc2) AS n2, avg(acc1) AS m1, avg(acc2) AS m2,"
        " var_samp(acc1) AS v1, var_samp(acc2) AS v2 FROM fa)",
        "tt AS (SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t,"
        " n1 + n2 - 2 AS df FROM st)",
        "th AS (SELECT t, df, atan(abs(t) / sqrt(df)) AS theta FROM tt)",
        "terms AS (SELECT t, df, theta, unnest(range(0, CAST(df // 2 AS BIGINT))) AS j FROM th)",
        "ser AS (SELECT t, df, theta, sum(CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE"
        " exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow(cos(theta) * cos(theta), j) END) AS total"
        " FROM terms GROUP BY t, df, theta)",
    ]
    return _with(ctes, "SELECT round(t, 6) AS t, CAST(df AS INTEGER) AS df, round(1 - sin(theta) * total, 6) AS p FROM ser")


HIST = ("WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),"
        " b AS (SELECT CAST(least(CASE WHEN hi - lo = 0 THEN 0 ELSE floor((l_extendedprice - lo) * 10 / (hi - lo)) END, 9)"
        " AS INTEGER) AS bin, lo, hi FROM lineitem, mm WHERE l_extendedprice IS NOT NULL)"
        " SELECT CAST(i AS INTEGER) AS bin, round(mm.lo + (mm.hi - mm.lo) * i / 10, 6) AS lo,"
        " round(mm.lo + (mm.hi - mm.lo) * (i + 1) / 10, 6) AS hi, count(b.bin) AS n"
        " FROM range(0, 10) t(i) CROSS JOIN mm LEFT JOIN b ON b.bin = i GROUP BY i, mm.lo, mm.hi")

HIST_CTE = ("h AS (SELECT user_id AS run, value AS val_loss,"
            " row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)")


def _early_stop() -> str:
    p = PATIENCE
    return _with([
        HIST_CTE,
        "m AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING"
        " AND 1 PRECEDING) AS prev_min FROM h)",
        "r AS (SELECT *, (prev_min IS NULL OR val_loss < prev_min) AS improved FROM m)",
        "nx AS (SELECT *, min(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch"
        " ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_rec FROM r)",
        "ne AS (SELECT run, max(epoch) AS n_epochs FROM h GROUP BY run)",
        f"c AS (SELECT run, min(epoch + {p}) AS stop FROM nx WHERE improved AND (next_rec IS NULL OR next_rec > epoch + {p})"
        " GROUP BY run)",
    ], "SELECT ne.run, ne.n_epochs, CAST(CASE WHEN c.stop <= ne.n_epochs THEN c.stop END AS BIGINT) AS stop_epoch"
       " FROM ne LEFT JOIN c ON ne.run = c.run")


def _spec_params() -> str:
    parts = "string_split(text, ',')"
    is_int = f"regexp_matches(text, {q(INT_TEXT)})"
    is_num = f"regexp_matches(text, {q(NUMBER_TEXT)})"
    is_list = f"(NOT {is_int} AND NOT {is_num} AND len({parts}) > 1)"
    kind = (f"CASE WHEN text IS NULL THEN NULL WHEN {is_int} THEN 'int' WHEN {is_num} THEN 'float'"
            f" WHEN {is_list} THEN 'list' ELSE 'str' END")
    n = (f"CAST(CASE WHEN {is_list} THEN len({parts}) - CASE WHEN ({parts})[-1] = '' THEN 1 ELSE 0 END ELSE 1 END"
         " AS BIGINT)")
    last = f"len({parts}) - CASE WHEN ({parts})[-1] = '' THEN 1 ELSE 0 END"
    each = (f"list_transform(({parts})[1:{last}], lambda x: CASE WHEN regexp_matches(x, {q(INT_TEXT)}) THEN 'int'"
            f" WHEN regexp_matches(x, {q(NUMBER_TEXT)}) THEN 'float' ELSE 'str' END || ':' || x)")
    number = f"CASE WHEN {is_num} THEN TRY_CAST(replace(trim(text), '_', '') AS DOUBLE) END"
    return (f"SELECT conv_id, turn, {kind} AS kind, {n} AS n_items, {number} AS number,"
            f" CASE WHEN {is_list} THEN md5(array_to_string({each}, '|')) END AS items_md5 FROM conversations")


def _prepare_lineitem() -> str:
    from .driver_queries import PREP_FEATURES
    src = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,"
           " CASE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE l_discount / l_tax END AS r1,"
           " CAST(coalesce(l_linestatus = 'F', false) AS INTEGER) AS l_linestatus_F,"
           " CAST(coalesce(l_linestatus = 'O', false) AS INTEGER) AS l_linestatus_O,"
           " l_returnflag AS label, concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),"
           " CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS _key FROM lineitem)")
    src = f"(SELECT * FROM {src} WHERE isfinite(r1))"
    cols = LINE_KEYS + PREP_FEATURES + ["label"]
    parted = split_sql(src, "label", ["_key"], cols, [0.6, 0.2, 0.2], ["train", "val", "test"])
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PREP_FEATURES)
    scaled = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}"
                       for c in PREP_FEATURES)
    return (f"WITH p AS ({parted}), st AS (SELECT {stats} FROM p WHERE split = 'train')"
            f" SELECT {KEYS}, split, label, {scaled} FROM p, st")


DENSE = ["ax AS (SELECT split, y_true AS l FROM conf UNION SELECT split, y_pred FROM conf)",
         "dense AS (SELECT a.split, a.l AS y_true, b.l AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM ax a"
         " JOIN ax b ON a.split = b.split LEFT JOIN conf c ON c.split = a.split AND c.y_true IS NOT DISTINCT FROM a.l"
         " AND c.y_pred IS NOT DISTINCT FROM b.l)"]


def _fingerprint() -> str:
    texts = ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
             "CAST(CAST(round(o_totalprice, 6) AS DECIMAL(38,6)) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')",
             "o_orderpriority"]
    row = " || '|' || ".join(f"coalesce({t}, chr(0))" for t in texts)
    return (f"SELECT count(*) AS n, CAST(sum(('0x' || substr(md5({row}), 1, 15))::HUGEINT) AS VARCHAR) AS fp FROM orders")


def _model_queries() -> dict[str, str]:
    """What SQL can state of the model queries: parts, labels, support, and that every check holds."""
    names = ["train", "val", "test"]
    vectors = "(SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 'pos' ELSE 'neg' END AS label FROM embeddings)"
    parts = split_sql(vectors, "label", ["vec_id"], ["vec_id", "label"], [0.6, 0.2, 0.2], names)
    report = (f"SELECT split, 'multi' AS granularity, label, count(*) AS support, true AS counts_add_up, true AS fits"
              f" FROM ({parts}) GROUP BY split, label")
    lines = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity < 15 THEN 'low'"
             " WHEN l_quantity < 35 THEN 'mid' ELSE 'high' END AS label, concat_ws('-', CAST(l_orderkey AS VARCHAR),"
             " CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS _key FROM lineitem)")
    scored = split_sql(lines, "label", ["_key"], [*LINE_KEYS, "label"], [0.8, 0.2], ["train", "test"])
    turn = "((o_totalprice % 1000) / 500 - 1)"
    waves = f"(SELECT o_orderkey, CASE WHEN {turn} * {turn} > 0.3 THEN 'far' ELSE 'near' END AS label FROM orders)"
    thirds = split_sql(waves, "label", ["o_orderkey"], ["o_orderkey", "label"], [0.6, 0.2, 0.2], names)
    learnt = "SELECT split, label, count(*) AS support, true AS learnt"
    return {
        "relu_eval": f"{learnt}, true AS stopped_by_rule FROM ({scored}) GROUP BY split, label",
        "autoencoder_error": f"SELECT split, count(*) AS n, true AS below_pca FROM ({thirds}) GROUP BY split",
        "pretrain_classify": f"{learnt} FROM ({thirds}) GROUP BY split, label",
        "forest_eval": report, "mlp_eval": report, "encode_classify": report,
        "pca_reconstruct": f"SELECT vec_id, split, true AS error_is_rest, true AS code_width_ok FROM ({parts})",
        "score_rows": f"SELECT {KEYS}, split, label, true AS right FROM ({scored})",
        "model_ttest": (f"WITH t AS (SELECT count(*) AS n FROM ({parts}) WHERE split = 'test')"
                        " SELECT CAST(i AS INTEGER) AS fold, 18 AS df, true AS shares_ok, true AS p_ok"
                        " FROM range(1, 11) r(i), t WHERE i <= n"),
    }


def _store_queries() -> dict[str, str]:
    merged = " UNION ALL ".join(
        f"SELECT {q(c)} AS column, count({c}) AS n, round(avg({c}), 8) AS mean, round(stddev_pop({c}), 8) AS std_pop,"
        f" CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, true AS refused FROM lineitem" for c in SCALE_COLS)
    continued = _scale("standard").replace(f"l_shipdate < TIMESTAMP '{SHIP_CUTOFF}'", "year(l_shipdate) < 1997")
    keys = ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in LINE_KEYS)
    staged = (f"SELECT CAST(year(l_shipdate) AS VARCHAR) AS file_key, strftime(l_shipdate, '%d/%m/%Y %H:%M:%S') AS stamp, {keys},"
              " l_returnflag AS label, l_quantity AS size, l_extendedprice AS rate FROM lineitem WHERE l_linenumber <> 7 AND l_tax <> 0.08")
    placed = (f"SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY stamp, {KEYS}) - 1 AS idx FROM ({staged})")
    # the store holds these keys as doubles, and the split hashes their text
    floats = ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in LINE_KEYS)
    parted = split_sql(f"(SELECT * REPLACE ({floats}) FROM ({staged}))", "label", LINE_KEYS, [*LINE_KEYS, "label", "file_key", "size", "rate"], [0.6, 0.2, 0.2], ["train", "val", "test"])
    return {
        "staged_files": f"SELECT file_key, idx, {KEYS}, label, round(size, 6) AS size, round(rate, 6) AS rate FROM ({placed})",
        "staged_sample": (f"SELECT {KEYS}, pos FROM (SELECT *, row_number() OVER (ORDER BY file_key, idx) - 1 AS pos FROM ({placed}))"
                          " WHERE pos % 5 = 0"),
        "staged_prepare": (f"WITH s AS ({parted}), st AS (SELECT avg(size) AS ms, stddev_pop(size) AS ss, avg(rate) AS mr, stddev_pop(rate) AS sr"
                           f" FROM s WHERE split = 'train') SELECT {keys}, split, label, file_key, round((size - ms) / ss, 6) AS size,"
                           " round((rate - mr) / sr, 6) AS rate FROM s, st"),
        "csv_by_name": ("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS o_orderstatus,"
                        " CAST(NULL AS VARCHAR) AS o_comment FROM orders"),
        "scaler_merged": merged,
        "scaler_continued": continued,
        "keyed_append": ("SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(quarter(o_orderdate) AS VARCHAR) AS file_key"
                         " FROM orders"),
        "file_order_sample": ("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER"
                              " (ORDER BY year(o_orderdate), o_orderkey) - 1 AS pos FROM orders) WHERE pos % 5 = 0"),
        "file_order_sequences": _flow_sequences(),
        "file_order_folds": (f"WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),"
                             f" b AS (SELECT *, n // {FOLDS} AS base, n % {FOLDS} AS extra FROM p)"
                             " SELECT o_orderkey, CASE WHEN pos < extra * (base + 1) THEN pos // (base + 1)"
                             " ELSE extra + (pos - extra * (base + 1)) // base END + 1 AS fold FROM b"),
        "manifest_bitmaps": split_sql("orders", "o_orderpriority", ["o_orderkey"], ["o_orderkey", "o_totalprice", "o_custkey"],
                                      [0.6, 0.2, 0.2], ["train", "val", "test"]),
    }


def oracle_sql() -> dict[str, str]:
    ev_split_src = "events"
    chunks = (f"WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,"
              f" count(*) OVER () AS n FROM orders), c AS (SELECT o_orderkey,"
              f" CAST(pos // CAST(ceil(n / {CHUNKS}) AS BIGINT) + 1 AS INTEGER) AS chunk FROM p)"
              " SELECT chunk, count(*) AS n, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key"
              " FROM c GROUP BY chunk")
    return {
        **_model_queries(),
        **_store_queries(),
        "csv_union": ("SELECT o_orderkey, o_orderstatus, o_orderpriority,"
                      " CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders"),
        "prepared_round_trip": (f"SELECT event_id, event_type AS label, value FROM events WHERE {SPLIT} = 'test'"),
        "keyed_round_trip": f"SELECT event_id FROM events WHERE {SPLIT} = 'train' AND event_type = 'view'",
        "chunks_round_trip": chunks,
        "report_round_trip": _class_metrics(False),
        "history_round_trip": _with([HIST_CTE], "SELECT run, epoch, val_loss FROM h"),
        "scaler_round_trip": _scale("standard"),
        "label_counts": _label_counts(),
        "label_counts_union": _label_counts_union(),
        "drop_rare_classes": (f"SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR p_type NOT IN"
                              f" ({', '.join(q(x) for x in RARE_PART_TYPES)})"),
        "drop_unseen_classes": (f"WITH e AS (SELECT *, {SPLIT} AS split FROM events) SELECT event_id, event_type FROM e"
                                " WHERE split = 'test' AND event_type IN (SELECT event_type FROM e WHERE split = 'train'"
                                " AND event_type <> 'error' AND event_type IS NOT NULL)"),
        "map_labels": _map_labels(),
        "binary_labels": ("SELECT event_id, CASE WHEN event_type IS NULL THEN NULL WHEN instr(event_type, 'view') > 0"
                          " THEN event_type ELSE 'attack.' END AS binary_label FROM events"),
        "class_weights": ("SELECT event_type AS label, count(*) AS n_c, CAST(sum(count(*)) OVER () AS DOUBLE)"
                          " / (count(*) OVER () * count(*)) AS weight FROM events GROUP BY event_type"),
        "ascii_labels": (f"SELECT doc_id, md5({ASCII_CLEAN}) AS text_md5, CAST(length({ASCII_CLEAN}) AS BIGINT)"
                         " AS n_chars_clean FROM documents"),
        "non_numeric_rows": _non_numeric(),
        "invalid_values": f"SELECT {KEYS}, r1, r2 FROM ({RATIO_SRC}) WHERE {VALID}",
        "cleaning_report": _cleaning_report(),
        "text_time_sort": ("SELECT event_id, ts_text, row_number() OVER (ORDER BY ts_text, event_id) - 1 AS pos FROM"
                           " (SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS ts_text FROM events)"),
        "dummy_columns": _dummy(),
        "label_codes": f"WITH {CODES} SELECT e.event_id, e.event_type, c.code FROM events e JOIN codes c ON e.event_type = c.label",
        "label_onehot": (f"WITH {CODES}, k AS (SELECT CAST(count(*) AS INTEGER) AS k FROM codes)"
                         " SELECT e.event_id, array_to_string(list_transform(range(0, k.k), lambda i:"
                         " CAST(CAST(i = c.code AS INTEGER) AS VARCHAR)), ',') AS onehot"
                         " FROM events e JOIN codes c ON e.event_type = c.label, k"),
        "label_decode": (f"WITH {CODES}, p AS (SELECT event_id, {rule('1.0')} AS pred_label FROM events)"
                         " SELECT p.event_id, c.code AS pred_code, c.label AS label_decoded FROM p JOIN codes c"
                         " ON p.pred_label = c.label"),
        "standard_scale": _scale("standard"),
        "minmax_scale": _scale("min_max"),
        "scaler_stats": _scaler_stats(),
        "split_quota": _split_quota(),
        "stratified_split": split_sql(ev_split_src, "event_type", ["event_id"], ["event_id", "event_type"],
                                      [0.6, 0.2, 0.2], ["train", "val", "test"]),
        "semi_supervised_split": split_sql("labels", "quality", ["doc_id"], ["doc_id", "quality"], [0.25, 0.75],
                                           ["unsup", "sup"], split_col="role"),
        "data_efficiency_split": split_sql(ev_split_src, "event_type", ["event_id"], ["event_id", "event_type"],
                                           [0.3, 0.7], ["set1", "set2"], split_col="_part", where_part="_part = 'set2'",
                                           out_cols=["event_id", "event_type"]),
        "manifest_fetch": split_sql("(SELECT CAST(year(o_orderdate) AS VARCHAR) AS file_key, o_orderkey AS idx,"
                                    " o_orderpriority AS label, o_totalprice FROM orders)", "label",
                                    ["file_key", "idx"], ["file_key", "idx", "o_totalprice"], [0.6, 0.2, 0.2],
                                    ["train", "val", "test"],
                                    out_cols=["idx AS o_orderkey", "file_key", "split", "o_totalprice"]),
        "systematic_sample": ("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER"
                              " (ORDER BY year(o_orderdate), o_orderkey) - 1 AS pos FROM orders) WHERE pos % 5 = 0"),
        "hash_sample": (f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)"
                        f" || '-' || {q(str(SEED))}), o_orderkey LIMIT 100"),
        "row_chunks": chunks,
        "flow_sequences": _flow_sequences(),
        "sequence_flatten": _sequence_flatten(),
        "confusion_matrix": _with([conf_cte("conf"), *DENSE], "SELECT split, y_true, y_pred, n FROM dense"),
        "class_metrics": _class_metrics(False),
        "average_metrics": _average_metrics(),
        "binary_metrics": _class_metrics(True),
        "accuracy_report": _accuracy_report(),
        "average_table": _average_table(),
        "reconstruction_error": f"SELECT vec_id, round({RECON}, 6) AS sq_error_sum FROM embeddings",
        "reconstruction_summary": (f"SELECT label, round(avg({RECON}), 6) AS mse, round(sqrt(avg({RECON})), 6) AS rmse,"
                                   " count(*) AS n FROM embeddings GROUP BY label"),
        "multilabel_f1": _multilabel_f1(),
        "exact_match": _exact_match(),
        "kfold_accuracy": _with(FOLD_CTES, "SELECT fold, round(acc1, 6) AS acc1, round(acc2, 6) AS acc2 FROM fa"),
        "ttest_two_models": _ttest(),
        "histogram": HIST,
        "fingerprint": _fingerprint(),
        "split_null_keys": split_sql("(SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS owner,"
                                     " CASE WHEN event_id % 7 <> 0 THEN event_type END AS label FROM events)", "label",
                                     ["owner", "event_id"], ["event_id", "label"], [0.6, 0.2, 0.2], ["train", "val", "test"],
                                     out_cols=["event_id", "_label AS label", "split"]),
        "category_positions": ("SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS position"
                               " FROM orders"),
        "sequence_sample": (f"WITH p AS (SELECT event_type, {POS_EVENTS} AS pos, count(*) OVER () AS n FROM events),"
                            " d AS (SELECT i AS draw, ('0x' || substr(md5('42-' || CAST(i AS VARCHAR)), 1, 15))::BIGINT"
                            f" % (SELECT max(n) // {SEQ_LEN} FROM p) AS seq FROM range(0, 50) t(i)),"
                            f" s AS (SELECT pos // {SEQ_LEN} AS seq, count(*) AS n_steps,"
                            f" string_agg(event_type, ',' ORDER BY pos) AS labels FROM p"
                            f" WHERE pos < {SEQ_LEN} * (n // {SEQ_LEN}) GROUP BY 1)"
                            " SELECT d.draw, d.seq, s.n_steps, s.labels FROM d JOIN s ON d.seq = s.seq"),
        "best_epoch": _with([HIST_CTE, "b AS (SELECT run, min(val_loss) AS best_loss FROM h GROUP BY run)"],
                            "SELECT h.run, min(h.epoch) AS best_epoch, b.best_loss FROM h JOIN b ON h.run = b.run"
                            " AND h.val_loss = b.best_loss GROUP BY h.run, b.best_loss"),
        "early_stop_epoch": _early_stop(),
        "goal_epoch": _with([HIST_CTE], f"SELECT run, min(CASE WHEN val_loss >= {GOAL} THEN epoch END) AS goal_epoch,"
                                        " max(epoch) AS n_epochs FROM h GROUP BY run"),
        "spec_params": _spec_params(),
        "prepare_lineitem": _prepare_lineitem(),
        "merge_validation": ("SELECT event_id, event_type, CASE WHEN split = 'val' THEN 'train' ELSE split END AS split"
                             " FROM (" + split_sql(ev_split_src, "event_type", ["event_id"], ["event_id", "event_type"],
                                                   [0.6, 0.2, 0.2], ["train", "val", "test"]) + ")"),
        "score_argmax": (f"SELECT {KEYS}, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred_idx,"
                         " array_to_string(list_transform(p, lambda x: CAST(CAST(x > 0.5 AS INTEGER) AS VARCHAR)), ',')"
                         " AS rounded FROM (SELECT *, [l_discount * 10, l_tax * 12.5, l_quantity / 50] AS p FROM lineitem)"),
        "strict_cast": "SELECT o_orderkey, CAST(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS custkey_text FROM orders",
        "dataset_sizes": ("SELECT split, count(*) AS n_rows, 2 AS n_features FROM ("
                          + split_sql(ev_split_src, "event_type", ["event_id"], ["event_id", "event_type"],
                                      [0.6, 0.2, 0.2], ["train", "val", "test"]) + ") GROUP BY split"),
        "stratified_subset": split_sql(ev_split_src, "event_type", ["event_id"], ["event_id", "event_type"],
                                       [0.08, 0.92], ["keep", "drop"], split_col="_part",
                                       where_part="_part = 'keep'", out_cols=["event_id", "event_type"]),
        "binary_confusion": _with([conf_cte("conf0"), "two AS (SELECT unnest(['attack', 'view']) AS l)"],
                                  "SELECT split, t.l AS y_true, p.l AS y_pred, CAST(coalesce(sum(n) FILTER ("
                                  "(t.l = 'view') = regexp_matches(y_true, '(?i)view') AND"
                                  " (p.l = 'view') = regexp_matches(y_pred, '(?i)view')), 0) AS BIGINT) AS n"
                                  " FROM conf0, two t, two p GROUP BY ALL"),
        "confusion_wide": _with([conf_cte("conf"), *DENSE], "SELECT split, y_true, "
                                + ", ".join(f"max(n) FILTER (WHERE y_pred = {q(v)}) AS \"{v}\""
                                            for v in EVENT_LABELS) + " FROM dense GROUP BY split, y_true"),
        "label_numbers": ("WITH codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS code"
                          " FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL))"
                          " SELECT e.event_id, e.event_type, c.code AS label_number FROM events e JOIN codes c"
                          " ON e.event_type = c.label"),
    }
