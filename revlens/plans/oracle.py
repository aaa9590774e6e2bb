"""DuckDB twins of the registered queries (the correctness oracle).

Written relationally and independently of the Spark code paths: lexicons are
VALUES tables joined to the reviews, whole-word matching uses RE2 boundary
groups (RE2 has no look-around), the scorer is a join with the weight table,
the rollup joins a batch x aspect frame. Tables ``documents``, ``embeddings``,
``pages``, ``conversations`` are the driver's views.
"""

from __future__ import annotations

from ..functions.lexicons import (API_LEXICON, APP_LEXICON, ASPECTS, JSON_LEXICON, NA_TOKENS,
                                  REVIEWS_LIMIT_APP, dedupe, is_word_keyword)
from ..operators.fitted import VOCABULARY
from ..operators.scoring import DEFAULT_BIAS, LinearScorer
from ..operators.spam import ALPHA, CELLS, DEFAULT_NUM_HASHES, FAMILY, LOOKS, MERSENNE_31, hash_params, look_z
from .derived import TEMPLATES, reviews_sql, sql_str
from .queries import ODD_NAMES

W = r"[^\p{L}\p{N}_]"
WORDS_RE2 = r"[^\p{L}\p{N}_]+"
WS_RE2 = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def _check_plain(kw: str) -> str:
    # Keywords are used unescaped inside RE2 patterns.
    assert all(ch.isalnum() or ch in " -_" for ch in kw), kw
    return kw


def lexicon_values(name: str, lex: dict, dedup: bool = False) -> str:
    rows = []
    for a_ord, (aspect, kws) in enumerate(lex.items()):
        seen = set()
        for k_ord, kw in enumerate(kws):
            if dedup and kw in seen:
                continue
            seen.add(kw)
            rows.append(f"({a_ord}, {sql_str(aspect)}, {k_ord}, {sql_str(_check_plain(kw))}, "
                        f"{'true' if is_word_keyword(kw) else 'false'})")
    return f"{name}(aspect_ord, aspect, kw_ord, keyword, single) AS (VALUES {', '.join(rows)})"


def match(n: str, k: str) -> str:
    """Whole-word match of keyword row ``k`` in review row ``n``."""
    return (f"(CASE WHEN {k}.single THEN list_contains({n}.words, {k}.keyword) "
            f"ELSE regexp_matches({n}.low, '(^|{W})' || {k}.keyword || '({W}|$)') END)")


def base_ctes() -> str:
    return f"""{reviews_sql()},
nn AS (SELECT review_id, batch, reviews, lower(reviews) AS low,
              regexp_split_to_array(lower(reviews), '{WORDS_RE2}') AS words
       FROM reviews WHERE reviews IS NOT NULL),
{lexicon_values('jlex', JSON_LEXICON)},
asp(aspect_ord, aspect) AS (VALUES {', '.join(f'({i}, {sql_str(a)})' for i, a in enumerate(ASPECTS))})"""


def per_hash(sig: str) -> str:
    """Pairs that agree per batch and hash, without those that only share a cell."""
    return f"""SELECT batch, k, (sum(c * (c - 1) / 2) - sum(c) * (sum(c) - 1) / 2 / {CELLS}) / (1 - 1.0 / {CELLS}) AS coll
           FROM (SELECT batch, k, mh % {CELLS} AS cell, count(*)::DOUBLE AS c FROM {sig} GROUP BY batch, k, cell) GROUP BY batch, k"""


def whole_per_hash(sig: str) -> str:
    """Pairs that agree per batch and hash."""
    return f"""SELECT batch, k, sum(c * (c - 1) / 2) AS coll
           FROM (SELECT batch, k, mh, count(*)::DOUBLE AS c FROM {sig} GROUP BY batch, k, mh) GROUP BY batch, k"""


def estimate_cte(name: str, sig: str, batches: str, k: int, per=per_hash) -> str:
    """Mean over the hashes of the share of agreeing pairs, and its error."""
    return f"""{name} AS (SELECT b.batch, b.n,
           CASE WHEN b.n > 1 THEN coalesce(sum(x.coll), 0) / (b.n * (b.n - 1) / 2 * {k}) ELSE 0.0 END AS jaccard_est,
           CASE WHEN b.n > 1 THEN coalesce(stddev_samp(x.coll), 0) / (b.n * (b.n - 1) / 2 * sqrt({k})) ELSE 0.0 END AS jaccard_se
        FROM {batches} b LEFT JOIN ({per(sig)}) x ON b.batch IS NOT DISTINCT FROM x.batch GROUP BY b.batch, b.n)"""


def gate_ctes(src: str = "nn") -> str:
    hpo = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(hash_params(FAMILY << (LOOKS - 1))))
    hp = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(hash_params(DEFAULT_NUM_HASHES)))
    p = MERSENNE_31
    return f"""st AS (SELECT review_id, batch, len(tok)::INTEGER AS n_tokens, list_distinct(tok) AS tset,
              len(list_distinct(tok))::INTEGER AS n_distinct,
              CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / len(tok) ELSE 0.0 END AS ttr
       FROM (SELECT review_id, batch, list_filter(regexp_split_to_array(reviews, '{WS_RE2}'), lambda x: x <> '') AS tok
             FROM {src})),
bt AS (SELECT batch, count(*) AS n, coalesce(round(avg(ttr), 3), 0.0) AS avg_ttr FROM st GROUP BY batch),
lo AS (SELECT batch, sum(m * (m - 1) / 2) AS lo_num
       FROM (SELECT batch, list_sort(tset) AS s, count(*) AS m FROM st WHERE n_distinct > 0 GROUP BY batch, list_sort(tset))
       GROUP BY batch),
hist AS (SELECT batch, n_distinct AS d, count(*) AS c FROM st GROUP BY batch, n_distinct),
hist2 AS (SELECT batch, d, c, coalesce(sum(c * d) OVER (PARTITION BY batch ORDER BY d
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist),
hi AS (SELECT batch, sum(CASE WHEN d > 0 THEN c * (c - 1) / 2 + c * below / d ELSE 0.0 END) AS hi_num,
              sum(c) AS n FROM hist2 GROUP BY batch),
bounds AS (SELECT hi.batch, hi.n,
              CASE WHEN hi.n * (hi.n - 1) / 2 > 0 THEN coalesce(lo.lo_num, 0) / (hi.n * (hi.n - 1) / 2) ELSE 0.0 END AS jaccard_lo,
              CASE WHEN hi.n * (hi.n - 1) / 2 > 0 THEN hi.hi_num / (hi.n * (hi.n - 1) / 2) ELSE 0.0 END AS jaccard_hi
           FROM hi LEFT JOIN lo ON hi.batch IS NOT DISTINCT FROM lo.batch),
hp(k, a, b) AS (VALUES {hp}),
post AS (SELECT batch, review_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {p} AS x
         FROM (SELECT batch, review_id, unnest(tset) AS t FROM st)),
sig AS (SELECT post.batch, post.review_id, hp.k, min((hp.a * post.x + hp.b) % {p}) AS mh
        FROM post CROSS JOIN hp GROUP BY post.batch, post.review_id, hp.k),
{estimate_cte("est", "sig", "bt", DEFAULT_NUM_HASHES)},
ph AS (SELECT batch, t, s, count(*) AS c
       FROM (SELECT batch, n_distinct AS s, unnest(tset) AS t FROM st) GROUP BY batch, t, s),
ph2 AS (SELECT batch, t, s, c, coalesce(sum(c) OVER (PARTITION BY batch, t ORDER BY s
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller FROM ph),
pws AS (SELECT batch, s, sum(c * (c - 1) / 2) AS w_s, sum(c * smaller / s) AS x_s FROM ph2 GROUP BY batch, s),
psz AS (SELECT batch, n_distinct AS s, count(*) AS n_s FROM st GROUP BY batch, n_distinct),
pb0 AS (SELECT psz.batch, psz.s, psz.n_s, psz.n_s * (psz.n_s - 1) / 2 AS p_s,
               coalesce(pws.w_s, 0.0) AS w_s, coalesce(pws.x_s, 0.0) AS x_s
        FROM psz LEFT JOIN pws ON psz.batch IS NOT DISTINCT FROM pws.batch AND psz.s = pws.s),
pb AS (SELECT batch, sum(n_s) AS n,
              sum(CASE WHEN p_s > 0 AND s > 0 THEN p_s * (w_s / p_s) / (2.0 * s - w_s / p_s) ELSE 0.0 END) AS lo_num,
              sum(CASE WHEN s > 0 THEN w_s / s + x_s ELSE 0.0 END) AS hi_num
       FROM pb0 GROUP BY batch),
pair AS (SELECT batch, n,
                CASE WHEN n * (n - 1) / 2 > 0 THEN lo_num / (n * (n - 1) / 2) ELSE 0.0 END AS pair_lo,
                CASE WHEN n * (n - 1) / 2 > 0 THEN hi_num / (n * (n - 1) / 2) ELSE 0.0 END AS pair_hi
         FROM pb),
tb AS (SELECT b.batch, b.jaccard_lo AS lo1, b.jaccard_hi AS hi1,
              greatest(b.jaccard_lo, coalesce(p.pair_lo, b.jaccard_lo)) AS jaccard_lo,
              least(b.jaccard_hi, coalesce(p.pair_hi, b.jaccard_hi)) AS jaccard_hi
       FROM bounds b LEFT JOIN pair p ON b.batch IS NOT DISTINCT FROM p.batch),
gate00 AS (SELECT bt.batch, bt.n, bt.avg_ttr, b.lo1, b.hi1, b.jaccard_lo, b.jaccard_hi,
             CASE WHEN bt.avg_ttr > 0.2 THEN 'ttr' WHEN round(b.lo1, 3) >= 0.8 THEN 'lower_bound'
                  WHEN round(b.hi1, 3) < 0.8 THEN 'upper_bound'
                  WHEN round(b.jaccard_lo, 3) >= 0.8 THEN 'pair_lower_bound'
                  WHEN round(b.jaccard_hi, 3) < 0.8 THEN 'pair_upper_bound' ELSE 'estimate' END AS decided_by
          FROM bt JOIN tb b ON bt.batch IS NOT DISTINCT FROM b.batch),
hpo(k, a, b) AS (VALUES {hpo}),
openb AS (SELECT batch, n, jaccard_lo, jaccard_hi FROM gate00 WHERE decided_by = 'estimate'),
sigo AS (SELECT post.batch, post.review_id, hpo.k, min((hpo.a * post.x + hpo.b) % {p}) AS mh
         FROM post JOIN openb ON post.batch IS NOT DISTINCT FROM openb.batch CROSS JOIN hpo GROUP BY post.batch, post.review_id, hpo.k),
ph_open AS ({per_hash("sigo")}),
look AS (SELECT b.batch, l.l, least(greatest(sum(x.coll) / (b.n * (b.n - 1) / 2 * l.k), any_value(b.jaccard_lo)), any_value(b.jaccard_hi)) AS est,
                stddev_samp(x.coll) / (b.n * (b.n - 1) / 2 * sqrt(l.k)) AS se, l.k
         FROM openb b CROSS JOIN (VALUES {", ".join(f"({l + 1}, {FAMILY << l})" for l in range(LOOKS))}) l(l, k)
         JOIN ph_open x ON b.batch IS NOT DISTINCT FROM x.batch AND x.k < l.k GROUP BY b.batch, b.n, l.l, l.k),
tested AS (SELECT *, NOT abs(est - 0.7995) > {look_z()} * se AS undecided FROM look),
stopped AS (SELECT batch, min(CASE WHEN NOT undecided OR l = {LOOKS} THEN l END) AS l FROM tested GROUP BY batch),
esto AS (SELECT t.batch, t.est AS jaccard_est, t.se AS jaccard_se, t.undecided, t.k::INTEGER AS n_hashes,
                CASE WHEN t.undecided THEN se * se / (se * se + (est - 0.7995) * (est - 0.7995)) ELSE {ALPHA} * t.l / {LOOKS} END AS error
         FROM tested t JOIN stopped s ON t.batch IS NOT DISTINCT FROM s.batch AND t.l = s.l),
gate0 AS (SELECT g.*, CASE WHEN decided_by IN ('ttr', 'lower_bound', 'upper_bound') THEN lo1 ELSE g.jaccard_lo END AS lo,
                 CASE WHEN decided_by IN ('ttr', 'lower_bound', 'upper_bound') THEN hi1 ELSE g.jaccard_hi END AS hi,
                 coalesce(eo.jaccard_est, e.jaccard_est) AS est_, coalesce(eo.jaccard_se, e.jaccard_se) AS se_,
                 coalesce(eo.undecided, false) AS undecided, coalesce(eo.n_hashes, {DEFAULT_NUM_HASHES})::INTEGER AS n_hashes,
                 round(coalesce(eo.error, 0.0), 6) AS error
          FROM gate00 g JOIN est e ON g.batch IS NOT DISTINCT FROM e.batch
          LEFT JOIN esto eo ON g.batch IS NOT DISTINCT FROM eo.batch),
gate1 AS (SELECT *, round(least(greatest(est_, lo), hi), 3) AS avg_jaccard,
                 CASE WHEN hi - lo < 1e-12 THEN 0.0 ELSE round(se_, 4) END AS jaccard_se FROM gate0),
gate AS (SELECT *, CASE WHEN decided_by = 'ttr' THEN false
                        WHEN decided_by IN ('lower_bound', 'pair_lower_bound') THEN true
                        WHEN decided_by IN ('upper_bound', 'pair_upper_bound') THEN false
                        ELSE avg_jaccard >= 0.8 END AS is_spam FROM gate1),
clean AS (SELECT * FROM {src} r
          WHERE NOT EXISTS (SELECT 1 FROM gate g WHERE g.is_spam AND g.batch IS NOT DISTINCT FROM r.batch))"""


def gate_expr(aspect: str, low: str = "low") -> str:
    kws = dedupe(API_LEXICON.get(aspect, []))
    if not kws:
        return "false"
    return "(" + " OR ".join(f"contains({low}, {sql_str(k)})" for k in kws) + ")"


def weight_values() -> str:
    sc = LinearScorer()
    rows = []
    for a in ASPECTS:
        for t, (wn, wu, wp) in sorted(sc.table(a).items()):
            rows.append(f"({sql_str(a)}, {sql_str(t)}, {wn}, {wu}, {wp})")
    return f"w(aspect, token, wn, wu, wp) AS (VALUES {', '.join(rows)})"


def scoring_ctes(src: str, max_tokens: int | None = None) -> str:
    b0, b1, b2 = DEFAULT_BIAS
    gates = ", ".join(f"{gate_expr(a)} AS g_{a}" for a in ASPECTS)
    on = " OR ".join(f"(a.aspect = {sql_str(a)} AND s.g_{a})" for a in ASPECTS)
    words = f"list_filter(words, lambda x: x <> '')[1:{max_tokens}]" if max_tokens else "words"
    return f"""sc AS (SELECT review_id, batch, reviews, low, words, {gates} FROM {src}),
gated AS (SELECT s.review_id, s.batch, a.aspect_ord, a.aspect FROM sc s JOIN asp a ON {on}),
{weight_values()},
pt AS (SELECT DISTINCT review_id, t AS token FROM (SELECT review_id, unnest({words}) AS t FROM sc)),
wsum AS (SELECT pt.review_id, w.aspect, sum(w.wn) AS sn, sum(w.wu) AS su, sum(w.wp) AS sp
         FROM pt JOIN w ON pt.token = w.token GROUP BY pt.review_id, w.aspect),
lg AS (SELECT g.review_id, g.batch, g.aspect_ord, g.aspect,
              ({b0} + coalesce(ws.sn, 0))::DOUBLE AS logit_neg, ({b1} + coalesce(ws.su, 0))::DOUBLE AS logit_neu,
              ({b2} + coalesce(ws.sp, 0))::DOUBLE AS logit_pos
       FROM gated g LEFT JOIN wsum ws ON ws.review_id = g.review_id AND ws.aspect = g.aspect),
lg2 AS (SELECT *, greatest(logit_neg, logit_neu, logit_pos) AS mx FROM lg),
lg3 AS (SELECT *, 1.0 / (exp(logit_neg - mx) + exp(logit_neu - mx) + exp(logit_pos - mx)) AS conf FROM lg2),
lab AS (SELECT *, CASE WHEN conf < 0.3 THEN 'Neutral' WHEN logit_neg = mx THEN 'Negative'
                       WHEN logit_neu = mx THEN 'Neutral' ELSE 'Positive' END AS sentiment FROM lg3)"""


def rollup_sql(neutral: str = "drop", by_batch: bool = True, src: str = "clean") -> str:
    neu = "count_if(l.sentiment = 'Neutral')" if neutral == "count" else "0::BIGINT"
    if by_batch:
        frame = f"SELECT b.batch, a.aspect_ord, a.aspect FROM (SELECT DISTINCT batch FROM {src}) b CROSS JOIN asp a"
        keys, join = "f.batch, ", "c.batch = f.batch AND "
        grp = "l.batch, "
    else:
        frame = "SELECT a.aspect_ord, a.aspect FROM asp a"
        keys, join, grp = "", "", ""
    return f"""WITH {base_ctes()},
{gate_ctes('nn')},
{scoring_ctes(src)},
cnt AS (SELECT {grp}l.aspect, count_if(l.sentiment = 'Positive') AS n_pos, {neu} AS n_neu,
               count_if(l.sentiment = 'Negative') AS n_neg FROM lab l GROUP BY {grp}l.aspect),
fr AS ({frame}),
cc AS (SELECT {keys}f.aspect_ord::INTEGER AS aspect_ord, f.aspect AS "Aspect", coalesce(c.n_pos, 0) AS n_pos,
              coalesce(c.n_neu, 0) AS n_neu, coalesce(c.n_neg, 0) AS n_neg
       FROM fr f LEFT JOIN cnt c ON {join}c.aspect = f.aspect),
pc AS (SELECT *, n_pos + n_neu + n_neg AS t FROM cc),
pp AS (SELECT * EXCLUDE (t),
              CASE WHEN t > 0 THEN n_pos / t * 100 ELSE 0.0 END AS "Positive",
              CASE WHEN t > 0 THEN n_neu / t * 100 ELSE 0.0 END AS "Neutral",
              CASE WHEN t > 0 THEN n_neg / t * 100 ELSE 0.0 END AS "Negative" FROM pc),
pm AS (SELECT *, greatest("Positive", "Neutral", "Negative") AS m FROM pp),
ps AS (SELECT * EXCLUDE (m), CASE WHEN "Negative" = m AND "Positive" < m AND "Neutral" < m THEN -m ELSE m END AS signed_pct
       FROM pm)"""


def q_rollup(neutral="drop", by_batch=True, src="clean") -> str:
    b = "batch, " if by_batch else ""
    return rollup_sql(neutral, by_batch, src) + f"""
SELECT {b}aspect_ord, "Aspect", "Positive", "Neutral", "Negative", signed_pct::VARCHAR AS "Sentiment", signed_pct FROM ps"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    base = base_ctes()

    q["aspect_gate_substring"] = f"""WITH {base}
SELECT review_id, batch, {', '.join(f'{gate_expr(a)} AS g_{a}' for a in ASPECTS)} FROM nn"""

    tag_m = f"""m AS (SELECT n.review_id, k.aspect_ord, k.aspect, k.kw_ord, k.keyword FROM nn n JOIN jlex k ON {match('n', 'k')})"""
    q["aspect_tags"] = f"""WITH {base}, {tag_m}
SELECT n.review_id,
       coalesce(string_agg(m.aspect, '|' ORDER BY m.aspect_ord, m.kw_ord), '') AS aspects,
       coalesce(string_agg(m.keyword, '|' ORDER BY m.aspect_ord, m.kw_ord), '') AS matched_keywords,
       count(m.review_id)::INTEGER AS n_tags
FROM nn n LEFT JOIN m ON n.review_id = m.review_id GROUP BY n.review_id"""

    q["aspects_distinct"] = f"""WITH {base}, {tag_m},
d AS (SELECT DISTINCT review_id, aspect_ord, aspect FROM m)
SELECT n.review_id, coalesce(string_agg(d.aspect, '|' ORDER BY d.aspect_ord), '') AS aspects
FROM nn n LEFT JOIN d ON n.review_id = d.review_id GROUP BY n.review_id"""

    q["keyword_counts"] = f"""WITH {base}, {tag_m}
SELECT aspect, keyword, count(*) AS n_reviews FROM m GROUP BY aspect, keyword"""

    q["aspect_key_counts"] = f"""WITH {base}, {tag_m}
SELECT replace(lower(aspect), ' ', '') AS aspect_key, count(*) AS n_reviews
FROM (SELECT DISTINCT review_id, aspect FROM m) GROUP BY 1"""

    gate = gate_ctes("nn")
    q["ttr_per_review"] = f"""WITH {base}, {gate}
SELECT review_id, batch, n_tokens, n_distinct, ttr FROM st"""
    q["batch_ttr"] = f"""WITH {base}, {gate}
SELECT batch, n, avg_ttr FROM bt"""
    q["batch_jaccard_bounds"] = f"""WITH {base}, {gate}
SELECT batch, n, round(jaccard_lo, 6) AS jaccard_lo, round(jaccard_hi, 6) AS jaccard_hi FROM bounds"""
    q["batch_jaccard_estimate"] = f"""WITH {base}, {gate},
{estimate_cte("whole", "sig", "bt", DEFAULT_NUM_HASHES, whole_per_hash)}
SELECT batch, n, round(jaccard_est, 6) AS jaccard_est, round(jaccard_se, 6) AS jaccard_se FROM whole"""
    q["batch_jaccard_pair_bounds"] = f"""WITH {base}, {gate}
SELECT batch, n, round(pair_lo, 6) AS pair_lo, round(pair_hi, 6) AS pair_hi FROM pair"""
    q["spam_gate"] = f"""WITH {base}, {gate}
SELECT batch, n, avg_ttr, avg_jaccard, jaccard_se, round(lo, 6) AS jaccard_lo, round(hi, 6) AS jaccard_hi,
       is_spam, decided_by, undecided, n_hashes, error FROM gate"""
    # The rule itself: mean type-token ratio, and mean over all pairs of reviews.
    q["spam_gate_exact"] = f"""WITH {base},
st AS (SELECT review_id, batch, tok, list_distinct(tok) AS s FROM (SELECT review_id, batch,
       list_filter(regexp_split_to_array(reviews, '{WS_RE2}'), lambda x: x <> '') AS tok FROM nn)),
t AS (SELECT batch, count(*) AS n, coalesce(round(avg(CASE WHEN len(tok) > 0 THEN len(s) / len(tok) ELSE 0.0 END), 3), 0.0) AS avg_ttr
      FROM st GROUP BY batch),
w AS (SELECT batch, s, count(*) AS m, min(review_id) AS id FROM st
      WHERE batch IN (SELECT batch FROM t WHERE avg_ttr <= 0.2) GROUP BY batch, s),
pr AS (SELECT a.batch, a.m * b.m AS m, CASE WHEN len(a.s) + len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s))
              / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS jac
       FROM w a JOIN w b ON a.batch = b.batch AND a.id < b.id
       UNION ALL SELECT batch, m * (m - 1) / 2, CASE WHEN len(s) > 0 THEN 1.0 ELSE 0.0 END FROM w),
j AS (SELECT batch, sum(m * jac) / sum(m) AS mean FROM pr WHERE m > 0 GROUP BY batch)
SELECT t.batch, t.n, t.avg_ttr, t.avg_ttr <= 0.2 AND coalesce(round(j.mean, 3), 0) >= 0.8 AS is_spam
FROM t LEFT JOIN j ON t.batch = j.batch"""
    q["clean_reviews"] = f"""WITH {base}, {gate}
SELECT review_id, batch, length(reviews)::INTEGER AS n_chars FROM clean"""

    score_nn = scoring_ctes("nn")
    q["sentiment_long"] = f"""WITH {base}, {score_nn}
SELECT review_id, aspect_ord::INTEGER AS aspect_ord, aspect, logit_neg, logit_neu, logit_pos,
       round(conf, 6) AS confidence, sentiment FROM lab"""
    cols = ", ".join(f"coalesce(max(CASE WHEN l.aspect = {sql_str(a)} THEN l.sentiment END), '') AS {a}"
                     for a in ASPECTS)
    q["sentiment_map"] = f"""WITH {base}, {score_nn}
SELECT n.review_id, {cols}, count(l.review_id)::INTEGER AS n_gated, 6 AS n_keys
FROM nn n LEFT JOIN lab l ON n.review_id = l.review_id GROUP BY n.review_id"""

    third = ", ".join(f"list_sum(list_filter(embedding::DOUBLE[], lambda x, i: (i - 1) % 3 = {c})) AS l{c}" for c in range(3))
    q["logits_to_label"] = f"""WITH e AS (SELECT vec_id, {third} FROM embeddings),
e2 AS (SELECT *, greatest(l0, l1, l2) AS mx FROM e),
e3 AS (SELECT *, 1.0 / (exp(l0 - mx) + exp(l1 - mx) + exp(l2 - mx)) AS conf FROM e2)
SELECT vec_id, CASE WHEN conf < 0.3 THEN 'Neutral' WHEN l0 = mx THEN 'Negative' WHEN l1 = mx THEN 'Neutral'
                    ELSE 'Positive' END AS label, round(conf, 6) AS confidence FROM e3"""

    q["score_counts"] = rollup_sql("drop", True) + """
SELECT batch, aspect_ord, "Aspect", n_pos, n_neu, n_neg FROM cc"""
    q["aspect_rollup"] = q_rollup("drop", True)
    q["aspect_rollup_neutral"] = q_rollup("count", True)
    q["aspect_rollup_total"] = q_rollup("drop", False)
    q["chart_feed"] = rollup_sql("drop", True) + """
SELECT batch, aspect_ord, "Aspect", signed_pct AS value,
       CASE WHEN signed_pct >= 0 THEN 'green' ELSE 'red' END AS color,
       printf('%.1f', signed_pct) AS label,
       CASE WHEN signed_pct >= 0 THEN 'left' ELSE 'right' END AS align,
       signed_pct + CASE WHEN signed_pct >= 0 THEN 0.01 ELSE -0.01 END AS label_x FROM ps"""

    q["masked_rows"] = f"""WITH {base}, {gate}, {scoring_ctes('clean')},
{lexicon_values('appk', APP_LEXICON, dedup=True)},
fk AS (SELECT l.review_id, l.aspect, arg_min(k.keyword, k.kw_ord) AS kw
       FROM lab l JOIN sc n ON n.review_id = l.review_id
       JOIN appk k ON k.aspect = l.aspect AND {match('n', 'k')}
       GROUP BY l.review_id, l.aspect)
SELECT l.review_id, l.aspect_ord::INTEGER AS aspect_ord, s.reviews AS "Reviews", l.aspect AS "Aspect",
       regexp_replace(s.low, '(^|{W})' || fk.kw || '({W}|$)', '\\1$T$\\2') AS "Formatted Review",
       l.sentiment AS "Sentiment"
FROM lab l JOIN sc s ON s.review_id = l.review_id
JOIN fk ON fk.review_id = l.review_id AND fk.aspect = l.aspect"""

    svals = ", ".join(f"coalesce(max(CASE WHEN l.aspect = {sql_str(a)} THEN l.sentiment END), '') AS s_{a}" for a in ASPECTS)
    # What the odd literals hold, in their order: number of entries, and the
    # string values under the fixed aspect keys.
    odd_size = "CASE nth WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END"
    odd_vals = ", ".join((f"CASE WHEN nth = 2 THEN 'x: None}}' END AS s_{a}" if a == "cost" else f"NULL::VARCHAR AS s_{a}") for a in ASPECTS)
    q["parse_literals"] = f"""WITH {base}, {score_nn}, {tag_m},
mt AS (SELECT review_id, count(*) AS c FROM m GROUP BY review_id),
odd AS (SELECT review_id, (abs(review_id) // 7) % 4 AS nth FROM nn WHERE abs(review_id) % 7 = 3)
SELECT n.review_id, coalesce(max(mt.c), 0)::INTEGER AS n_aspects, 6::INTEGER AS n_sentiments, {svals}
FROM nn n LEFT JOIN lab l ON n.review_id = l.review_id LEFT JOIN mt ON mt.review_id = n.review_id
GROUP BY n.review_id
UNION ALL
SELECT -1000000000000 - review_id, 0::INTEGER, ({odd_size})::INTEGER, {odd_vals} FROM odd"""

    q["payload_explode"] = f"""WITH {base}
SELECT batch AS hospital_name, floor(review_id / {REVIEWS_LIMIT_APP})::BIGINT AS chunk,
       (row_number() OVER (PARTITION BY batch, floor(review_id / {REVIEWS_LIMIT_APP}) ORDER BY review_id) - 1)::INTEGER AS pos,
       'Author ' || review_id::VARCHAR AS author, reviews FROM nn"""

    q["review_limit"] = f"""WITH {base}
SELECT batch, review_id, rk::INTEGER AS "rank"
FROM (SELECT batch, review_id, row_number() OVER (PARTITION BY batch ORDER BY review_id) AS rk FROM nn)
WHERE rk <= {REVIEWS_LIMIT_APP}"""

    q["request_url"] = """SELECT page_id, replace(url_encode(url), '%2F', '/') AS url_key FROM pages"""
    names = "[" + ", ".join(sql_str(x) for x in ODD_NAMES) + "]"
    q["request_name"] = f"""WITH n AS (SELECT doc_id, {names}[doc_id % {len(ODD_NAMES)} + 1] || ' ' || source AS hospital_name FROM documents)
SELECT doc_id, hospital_name, replace(url_encode(hospital_name), '%2F', '/') AS query_key FROM n"""

    na = ", ".join(sql_str(t) for t in NA_TOKENS)
    cells = f"""cells AS (SELECT conv_id, turn, role, CASE WHEN (conv_id * 31 + turn) % 5 = 0
                     THEN [{na}][((conv_id * 31 + turn) // 5) % {len(NA_TOKENS)} + 1] ELSE text END AS text FROM conversations)"""
    q["na_normalise"] = f"""WITH {cells} SELECT role, count(*) AS n_rows, count(CASE WHEN text NOT IN ({na}) THEN text END) AS n_text
FROM cells GROUP BY role"""
    q["nan_cells"] = f"""WITH {cells} SELECT conv_id, turn, CASE WHEN text IS NULL OR text IN ({na}) THEN 'nan' ELSE text END AS text FROM cells"""

    q["payload_files"] = f"""WITH {base} SELECT batch AS hospital_name, 'Author ' || review_id::VARCHAR AS author, reviews FROM nn"""
    q["csv_roundtrip"] = f"""WITH {base} SELECT review_id, batch, CASE WHEN abs(review_id) % 11 = 5 THEN NULL ELSE reviews END AS reviews FROM reviews"""
    q["xlsx_roundtrip"] = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END AS "Urgent",
       CASE WHEN doc_id % 13 = 4 THEN NULL ELSE text END AS reviews, 'reviews-' || (doc_id // 100)::VARCHAR || '.xlsx' AS source_file FROM documents"""
    lex_words = f"list_filter(regexp_split_to_array(lower(text), '{WORDS_RE2}'), lambda x: x <> '')"
    data_lexicon = f"""lex AS (SELECT DISTINCT 'benchmark' AS aspect, unnest({lex_words}) AS keyword FROM benchmark
        UNION SELECT 'opening', array_to_string(({lex_words})[1:2], ' ') FROM documents WHERE len({lex_words}) > 0)"""
    q["lexicon_hits"] = f"""WITH {base}, {data_lexicon},
w AS (SELECT review_id, list_filter(words, lambda x: x <> '') AS ws FROM nn),
grams AS (SELECT DISTINCT review_id, unnest(ws) AS gram FROM w
          UNION SELECT review_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT review_id, ws, unnest(range(1, len(ws))) AS i FROM w))
SELECT aspect, keyword, count(*) AS n_reviews FROM lex JOIN grams ON gram = keyword GROUP BY aspect, keyword"""
    q["substring_hits"] = f"""WITH {base}, {data_lexicon}
SELECT aspect, keyword, count(*) AS n_reviews FROM lex JOIN nn ON contains(low, keyword) GROUP BY aspect, keyword"""
    q["attach_by_position"] = f"""WITH {base}
SELECT row_number() OVER (ORDER BY review_id) - 1 AS "position", review_id, batch, length(reviews)::INTEGER AS n_chars FROM nn"""
    q["masked_export"] = f"""SELECT "Aspect", "Sentiment", count(*) AS n_rows, sum(length("Reviews"))::BIGINT AS review_chars,
       sum(length("Formatted Review"))::BIGINT AS masked_chars FROM ({q["masked_rows"]}) GROUP BY 1, 2"""
    q["template_jaccard_whole"] = f"""WITH {base},
t AS (SELECT review_id, list_distinct(list_filter(regexp_split_to_array(reviews, '{WS_RE2}'), lambda x: x <> '')) AS a,
             list_distinct(list_filter(regexp_split_to_array(t_text, '{WS_RE2}'), lambda x: x <> '')) AS b
      FROM nn JOIN templates ON t_id = review_id % {len(TEMPLATES)} WHERE review_id >= 0)
SELECT review_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE
       len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS jaccard FROM t"""
    short = scoring_ctes("nn", max_tokens=64)
    q["sentiment_truncated"] = f"""WITH {base}, {short}
SELECT review_id, aspect, logit_neg, logit_neu, logit_pos, sentiment FROM lab"""
    by_length = ", ".join(
        f"CASE WHEN NOT {gate_expr(a)} THEN '' ELSE "
        + (f"(['Negative', 'Neutral', 'Positive'])[(length(reviews) + {k}) % 3 + 1]" if k < 2 else "'Neutral'") + f" END AS {a}"
        for k, a in enumerate(ASPECTS))
    q["model_labels"] = f"""WITH {base} SELECT review_id, {by_length} FROM nn"""
    labels = ", ".join(f"coalesce(max(CASE WHEN l.aspect = {sql_str(a)} THEN l.sentiment END), '') AS {a}" for a in ASPECTS)
    q["stream_predict"] = f"""WITH {base}, {score_nn}
SELECT n.review_id, {labels} FROM nn n LEFT JOIN lab l ON n.review_id = l.review_id GROUP BY n.review_id"""
    q["stream_gate"] = f"""WITH {base}, {gate},
one AS (SELECT g.batch, g.n, g.avg_ttr, least(greatest(e.jaccard_est, g.lo1), g.hi1) AS est, e.jaccard_se AS se,
               CASE WHEN g.avg_ttr > 0.2 THEN 'ttr' WHEN round(g.lo1, 3) >= 0.8 THEN 'lower_bound'
                    WHEN round(g.hi1, 3) < 0.8 THEN 'upper_bound' ELSE 'estimate' END AS decided_by
        FROM gate00 g JOIN est e ON g.batch IS NOT DISTINCT FROM e.batch)
SELECT batch, n, avg_ttr, round(est, 3) AS avg_jaccard, round(se, 4) AS jaccard_se,
       decided_by = 'lower_bound' OR (decided_by = 'estimate' AND round(est, 3) >= 0.8) AS is_spam, decided_by,
       decided_by = 'estimate' AND abs(est - 0.7995) <= {look_z(looks=1)} * se AS undecided FROM one"""
    q["stream_review_limit"] = f"""WITH {base}
SELECT batch, review_id, rk::INTEGER AS "rank", length(reviews)::INTEGER AS n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY review_id) AS rk FROM nn) WHERE rk <= {REVIEWS_LIMIT_APP}"""
    q["ordered_export"] = f"""SELECT row_number() OVER (ORDER BY review_id, aspect_ord) - 1 AS "position",
       "Reviews", "Aspect", "Formatted Review", "Sentiment" FROM ({q["masked_rows"]})"""
    q["fitted_labels"] = f"""WITH {base}, {score_nn},
tok AS (SELECT review_id, unnest(list_filter(words, lambda x: x <> '')) AS word FROM nn),
vocab AS (SELECT word FROM tok GROUP BY word ORDER BY count(*) DESC, word LIMIT {VOCABULARY}),
tf AS (SELECT review_id, word, count(*)::DOUBLE AS c FROM tok JOIN vocab USING (word) GROUP BY review_id, word),
cls(k, cls) AS (VALUES (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')),
docs AS (SELECT a.aspect, cls.k, cls.cls, count(l.review_id) + 1 AS n FROM asp a CROSS JOIN cls
         LEFT JOIN lab l ON l.aspect = a.aspect AND l.sentiment = cls.cls GROUP BY ALL),
sums AS (SELECT l.aspect, l.sentiment AS cls, tf.word, sum(tf.c) AS s FROM lab l JOIN tf ON tf.review_id = l.review_id GROUP BY ALL),
cell AS (SELECT d.aspect, d.k, v.word, ln(coalesce(s.s, 0) + 1) AS lw FROM docs d CROSS JOIN vocab v
         LEFT JOIN sums s ON s.aspect = d.aspect AND s.cls = d.cls AND s.word = v.word),
prior AS (SELECT d.aspect, d.k, ln(d.n + 1) - ln(sum(d.n) OVER (PARTITION BY d.aspect) + 3) AS lp,
                 ln(coalesce((SELECT sum(s.s) FROM sums s WHERE s.aspect = d.aspect AND s.cls = d.cls), 0) + (SELECT count(*) FROM vocab)) AS ld FROM docs d),
part AS (SELECT l.review_id, l.aspect, c.k, sum(tf.c * c.lw) AS lw, sum(tf.c) AS n
         FROM lab l JOIN tf ON tf.review_id = l.review_id JOIN cell c ON c.aspect = l.aspect AND c.word = tf.word GROUP BY ALL),
raw AS (SELECT l.review_id, l.aspect, p.k, p.lp + coalesce(t.lw - t.n * p.ld, 0) AS x FROM lab l JOIN prior p ON p.aspect = l.aspect
        LEFT JOIN part t ON t.review_id = l.review_id AND t.aspect = l.aspect AND t.k = p.k)
SELECT review_id, aspect, round(max(x) FILTER (k = 0), 3) AS log_neg, round(max(x) FILTER (k = 1), 3) AS log_neu,
       round(max(x) FILTER (k = 2), 3) AS log_pos, (['Negative', 'Neutral', 'Positive'])[arg_max(k, x) + 1] AS sentiment FROM raw GROUP BY review_id, aspect"""
    q["stream_rollup"] = q_rollup("drop", True, src="nn")
    return q
