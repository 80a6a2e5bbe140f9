"""SQL twins of the registered queries, for DuckDB on the same tables.

Written from the semantics and not from the DataFrame code: statuses as two filters, as-of attribution as a
ranked join, newness as NOT EXISTS per order, distinct counts as COUNT(DISTINCT CASE ...).
"""

from __future__ import annotations

RAW = """
raw AS (
  SELECT o_orderkey AS order_id, o_orderdate AS created_date, c_name AS customer_email, c_name AS user_name,
    n_name AS institution, n_name AS territory, 'L' || (o_orderkey % 8) AS lob_type,
    o_orderpriority AS order_type, o_orderpriority AS priority,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Ready To Order' ELSE 'Complete' END
         WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Cart' ELSE 'In Process' END
         WHEN o_orderkey % 3 = 0 THEN 'Draft' WHEN o_orderkey % 3 = 1 THEN 'Pending Quote'
         ELSE 'Discard' END AS order_status,
    CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderkey AS VARCHAR) END AS quotation_number,
    CASE WHEN o_orderkey % 10 <= 2 THEN 'FLASH-' || (o_orderkey % 10)
         WHEN o_orderkey % 10 <= 5 THEN 'NGS-' || (o_orderkey % 10) END AS promotion_code,
    CASE o_custkey % 20 WHEN 0 THEN 'JPY.￥' WHEN 1 THEN '£' WHEN 2 THEN '€' WHEN 3 THEN 'AU$' ELSE '$' END ||
    CASE WHEN o_orderkey % 50 = 7 THEN '0.0000'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) END AS billing_amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

STATUS_OK = """(
  (lob_type NOT IN ('L0','L1','L2','L3','L7')
   AND order_status NOT IN ('Cart','Discard','Draft','Pending Quote','Ready To Order'))
  OR (lob_type IN ('L0','L1','L2','L3','L7') AND order_status NOT IN ('Draft','Pending Quote')
      AND NOT (quotation_number IS NOT NULL AND order_status IN ('Cart','Ready To Order')))
)"""
TERRITORY_OK = "territory NOT IN ('NATION_20','NATION_21')"
AMOUNT_OK = """(billing_amount <> '$0.0000' AND NOT contains(billing_amount, 'JPY.')
  AND NOT contains(billing_amount, '£') AND NOT contains(billing_amount, '€'))"""
AMOUNT = """CASE WHEN contains(billing_amount, 'AU')
  THEN round_even(CAST(substr(billing_amount, 4) AS DOUBLE) * 0.69 * 10000, 0) / 10000
  ELSE round_even(CAST(substr(billing_amount, 2) AS DOUBLE) * 10000, 0) / 10000 END"""
REMAP = "CASE WHEN lob_type = 'L7' THEN 'L0' ELSE lob_type END"

CLEAN = f"""{RAW},
clean AS (
  SELECT order_id, created_date, customer_email, user_name, institution, territory, {REMAP} AS lob_type,
    order_type, priority, order_status, quotation_number, promotion_code, {AMOUNT} AS billing_amount
  FROM raw
  WHERE {STATUS_OK} AND {TERRITORY_OK} AND {AMOUNT_OK} AND NOT contains(institution, 'NATION_24')
)"""

LOB = "CASE WHEN lob_type = 'L6' THEN 'L6' ELSE 'c' || substr(lob_type, 2) END"
QUOTE = "lob_type IN ('L0','L1','L2','L3')"
OPEN = "order_status IN ('Cart','Discard','Ready To Order')"
CONFIRMED3 = f"CASE WHEN {QUOTE} AND {OPEN} THEN 'non_confirmed' ELSE 'confirmed' END"
CONFIRMED2 = f"CASE WHEN {OPEN} THEN 'non_confirmed' ELSE 'confirmed' END"

SALES = f"""{CLEAN},
sales AS (
  SELECT order_id, created_date, lower(customer_email) AS customer_email, user_name, institution, lob_type,
    {LOB} AS lob, lower(customer_email || '*' || {LOB}) AS email_lob, order_type, priority, order_status,
    promotion_code, billing_amount,
    CASE WHEN {QUOTE} THEN 1 ELSE 0 END AS quote_based, {CONFIRMED3} AS confirmed
  FROM clean
),
history AS (SELECT customer_email, email_lob FROM sales WHERE created_date < TIMESTAMP '1996-01-01'),
cur AS (SELECT * FROM sales WHERE created_date >= TIMESTAMP '1996-01-01')"""

LISTS = """lists AS (
  SELECT event_type AS campaign, printf('customer#%09d', user_id) AS recipient, value > 250 AS clicked
  FROM events WHERE event_type IN ('view','click')
)"""

SHIP = """ship AS (
  SELECT 'camp_' || lower(l_returnflag) AS campaign, printf('customer#%09d', o_custkey) AS recipient,
    l_shipdate AS sent_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
idx(campaign, combined_name, sent_date, pos) AS (
  VALUES ('camp_a', 'ship_an', TIMESTAMP '1996-01-01', 0), ('camp_n', 'ship_an', TIMESTAMP '1996-07-01', 1),
         ('camp_r', 'ship_r', TIMESTAMP '1997-01-01', 2)
),
elig(campaign, order_type) AS (
  VALUES ('camp_a','1-URGENT'), ('camp_n','1-URGENT'), ('camp_n','2-HIGH'), ('camp_r','2-HIGH'),
         ('camp_a','3-MEDIUM'), ('camp_r','3-MEDIUM')
)"""

FLASH = f"""{SALES}, {LISTS},
flash AS (SELECT * FROM sales WHERE created_date >= TIMESTAMP '1997-01-01'
          AND contains(lower(promotion_code), 'flash')),
labelled AS (
  SELECT f.*, m.campaign AS recent_open
  FROM flash f JOIN (SELECT DISTINCT campaign, recipient FROM lists) m ON f.customer_email = m.recipient
)"""


def _ranked(orders: str, touches: str, pairs: str) -> str:
    """The latest earlier eligible touch of every order, by ranking all of them."""
    return f"""labelled AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT o.*, t.campaign AS recent_open,
      row_number() OVER (PARTITION BY o.order_id ORDER BY t.sent_at DESC, e.pos) AS rn
    FROM {orders} o
    JOIN {touches} t ON t.recipient = o.customer_email AND t.sent_at < o.created_date
    JOIN {pairs} e ON e.campaign = t.campaign AND e.order_type = o.order_type
  ) WHERE rn = 1
)"""


SHIP_PAIRS = "(SELECT elig.campaign, order_type, pos FROM elig JOIN idx ON elig.campaign = idx.campaign)"
IN_SCOPE = "(lob_type IN ('L1','L2','L3') OR (lob_type = 'L0' AND priority IN ('1-URGENT','3-MEDIUM')))"
TOUCH = f"{SALES}, {SHIP}, {_ranked('cur', 'ship', SHIP_PAIRS)}"
SCOPED = f"(SELECT * REPLACE ({CONFIRMED2} AS confirmed) FROM cur WHERE {IN_SCOPE})"
PROMO = f"{SALES}, {SHIP}, {_ranked(SCOPED, 'ship', SHIP_PAIRS)}"
REGION = f"""{SALES}, {SHIP},
labelled AS (
  SELECT s.*, 'camp_r' AS recent_open FROM sales s
  WHERE created_date >= TIMESTAMP '1997-07-01' AND created_date <= TIMESTAMP '1997-08-01'
    AND customer_email IN (SELECT recipient FROM ship WHERE campaign = 'camp_r')
)"""


MANY = f"""{SALES}, {SHIP},
win(campaign, start, scope) AS (
  VALUES ('camp_a', TIMESTAMP '1996-01-01', NULL), ('camp_n', TIMESTAMP '1996-07-01', ['L2','L3']),
         ('camp_r', TIMESTAMP '1997-01-01', ['L0','L4'])
),
labelled AS (
  SELECT s.*, w.campaign AS recent_open FROM sales s
  JOIN win w ON s.created_date >= w.start AND s.created_date <= w.start + INTERVAL 31 DAY
    AND (w.scope IS NULL OR list_contains(w.scope, s.lob_type))
  WHERE EXISTS (SELECT 1 FROM ship t WHERE t.campaign = w.campaign AND t.recipient = s.customer_email)
)"""


def _flags(cutoff: str, source: str = "labelled") -> str:
    """Newness of every order by looking its keys up among history and earlier orders."""

    def known(key: str) -> str:
        return (
            f"({key} IN (SELECT h.{key} FROM history h) OR EXISTS (SELECT 1 FROM cur p "
            f"WHERE p.{key} = l.{key} AND p.created_date < {cutoff}))"
        )

    return f"""flagged0 AS (
  SELECT l.*, i.combined_name AS combined_email,
    CASE WHEN {known('customer_email')} THEN 0 ELSE 1 END AS new_to_company,
    CASE WHEN {known('email_lob')} THEN 0 ELSE 1 END AS line_new
  FROM {source} l LEFT JOIN idx i ON i.campaign = l.recent_open
),
flagged AS (SELECT * EXCLUDE (line_new),
  CASE WHEN new_to_company = 0 THEN line_new END AS new_to_lob FROM flagged0)"""


NO_INDEX = "idx(campaign, combined_name) AS (VALUES ('', ''))"
FLASH_FLAGGED = f"{FLASH}, {NO_INDEX}, {_flags('''TIMESTAMP '1997-01-01' ''')}"
TOUCH_FLAGGED = f"{TOUCH}, {_flags('i.sent_date')}"
PROMO_FLAGGED = f"{PROMO}, {_flags('i.sent_date')}"
MANY_FLAGGED = f"{MANY}, {_flags('i.sent_date')}"
REGION_FLAGGED = f"{REGION}, {_flags('''TIMESTAMP '1997-07-01' ''')}"


def _count(when: str, name: str) -> str:
    return f'count(CASE WHEN {when} THEN customer_email END) AS "{name}"'


def _sum(when: str, name: str) -> str:
    return f'round(sum(CASE WHEN {when} THEN billing_amount ELSE 0 END), 4) AS "{name}"'


def _distinct(when: str, name: str) -> str:
    return f'count(DISTINCT CASE WHEN {when} THEN customer_email END) AS "{name}"'


def _quote(lines: list[str], word: str = "Number") -> list[str]:
    out = []
    for line in lines:
        for state, title in (("non_confirmed", "NonConfirmed"), ("confirmed", "Confirmed")):
            when = f"lob_type = '{line}' AND confirmed = '{state}'"
            out += [_count(when, f"{line}_{title}{word}"), _sum(when, f"{line}_{title}Revenue")]
    return out


def _direct() -> list[str]:
    out = []
    for line in ("L4", "L5", "L6"):
        when = f"lob_type = '{line}'"
        out += [_count(when, f"{line}_Order"), _sum(when, f"{line}_Revenue")]
    return out


LINE_CASES = [(f"C{i}", f"new_to_lob = 1 AND lob = '{'L6' if i == 6 else f'c{i}'}'") for i in range(7)]
ANY_LINE = [("LoB", "new_to_lob = 1")]


def _status(lines: list[tuple[str, str]]) -> list[str]:
    out = [_count("new_to_company = 0", "Return_Order"), _sum("new_to_company = 0", "Return_Revenue")]
    for label, when in [("Company", "new_to_company = 1"), *lines]:
        out += [_count(when, f"NewTo{label}_Order"), _sum(when, f"NewTo{label}_Revenue")]
    return out


def _acquired(lines: list[tuple[str, str]]) -> list[str]:
    return [_distinct(when, f"NewTo{label}") for label, when in [("Company", "new_to_company = 1"), *lines]]


UNIQUE = ['count(DISTINCT customer_email) AS "# of unique customers"']
CONFIRMED_ALL = [
    _count("confirmed = 'non_confirmed'", "NonConfirmedOrder"),
    _sum("confirmed = 'non_confirmed'", "NonConfirmedRevenue"),
    _count("confirmed = 'confirmed'", "ConfirmedOrder"),
    _sum("confirmed = 'confirmed'", "ConfirmedRevenue"),
]
BUNDLE = _quote(["L0", "L1", "L2", "L3"]) + _direct() + _status(LINE_CASES) + _acquired(LINE_CASES) + UNIQUE


def _report(
    ctes: str, columns: list[str], names: list[str], source: str = "flagged", key: str = "recent_open"
) -> str:
    rows = ", ".join(f"('{n}')" for n in names)
    return f"""WITH {ctes},
agg AS (SELECT {key}, {', '.join(columns)} FROM {source} GROUP BY {key}),
spine({key}) AS (VALUES {rows})
SELECT * FROM spine LEFT JOIN agg USING ({key})"""


SHIP_NAMES = ["camp_a", "camp_n", "camp_r"]


def _levels(ctes: str, columns: list[str]) -> str:
    """One aggregation for every level."""
    parts = [("campaign", "recent_open"), ("combined", "combined_email"), ("total", None)]
    rows = [
        f"SELECT '{level}' AS level, {key or 'CAST(NULL AS VARCHAR)'} AS key, {', '.join(columns)} FROM flagged"
        + (f" WHERE {key} IS NOT NULL GROUP BY {key}" if key else "")
        for level, key in parts
    ]
    return f"WITH {ctes} {' UNION ALL '.join(rows)}"


def _breakdown() -> str:
    parts = []
    for line in ("L0", "L1", "L2", "L3"):
        open_ = f"lob_type = '{line}' AND confirmed = 'non_confirmed'"
        done = f"lob_type = '{line}' AND confirmed = 'confirmed'"
        parts += [
            (f"{line}_Total", f"lob_type = '{line}'"),
            (f"{line}_NonConfirmedRevenue", open_),
            (f"{line}_ConfirmedRevenue", done),
        ]
    parts += [(f"{line}_Revenue", f"lob_type = '{line}'") for line in ("L4", "L5", "L6")]

    def one(source: str, when: str) -> str:
        return f"(SELECT round(sum(CASE WHEN {when} THEN billing_amount ELSE 0 END), 4) FROM {source})"

    rows = [
        f"""SELECT {i} AS pos, '{name}' AS metric, {one('flash', when)} AS "All Sources",
        {one('labelled', when)} AS "Open Email", {one('clicked', when)} AS "Open & Click" """
        for i, (name, when) in enumerate(parts)
    ]
    return f"""WITH {FLASH},
clicked AS (SELECT f.* FROM flash f
  JOIN (SELECT DISTINCT campaign, recipient FROM lists WHERE clicked) m ON f.customer_email = m.recipient)
{' UNION ALL '.join(rows)}"""


def _window(scope: str, column: str) -> str:
    return f"""WITH {SALES}, {SHIP}
SELECT order_id, 'camp_r' AS recent_open, created_date, {column} FROM sales
WHERE {scope} AND created_date BETWEEN TIMESTAMP '1997-07-01' AND TIMESTAMP '1997-08-01'
  AND customer_email IN (SELECT recipient FROM ship WHERE campaign = 'camp_r')"""


PLAIN = """plain AS (
  SELECT o_orderkey AS order_id, printf('customer#%09d', o_custkey) AS customer_email,
    o_orderdate AS created_date, o_orderpriority AS order_type FROM orders
)"""

EVENT_TOUCHES = """et AS (
  SELECT event_type || '-w' || CAST((day(ts) - 1) // 7 AS INTEGER) AS campaign,
    CAST(user_id AS VARCHAR) AS recipient, ts AS sent_at
  FROM events WHERE event_type IN ('view','click','signup')
),
eo AS (SELECT event_id AS order_id, CAST(user_id AS VARCHAR) AS customer_email, ts AS created_date,
  event_type AS order_type FROM events WHERE event_type = 'purchase'),
ep AS (SELECT kind || '-w' || w AS campaign, 'purchase' AS order_type, 5 * k + w AS pos
  FROM (VALUES ('view', 0), ('click', 1), ('signup', 2)) t(kind, k), (VALUES (0),(1),(2),(3),(4)) v(w))"""

REGIONAL_NAMES = [
    "# of Order", "Revenue", "Return_Order", "Return_Revenue", "NewToCompany_Order", "NewToCompany_Revenue",
    "NewToLoB_Order", "NewToLoB_Revenue", "NewToCompany", "NewToLoB", "# of unique customers",
]

def _export(shape: str = "FALSE") -> str:
    """The spoiled export with the fate of every order; ``shape`` says which rows have the wrong number of fields."""
    return f"""{RAW},
export AS (
  SELECT * REPLACE (CASE WHEN order_id % 13 <> 0 THEN
      CASE WHEN order_id % 11 = 0 THEN billing_amount || ' net' ELSE billing_amount END END AS billing_amount),
    CASE WHEN order_id % 17 = 0 THEN 'next week' WHEN order_id % 19 = 0 THEN '30/07/2019' END AS bad_time
  FROM raw
),
fates AS (
  SELECT *, CASE WHEN {shape} THEN 'row shape' WHEN NOT {STATUS_OK} THEN 'status' WHEN NOT {TERRITORY_OK} THEN 'territory'
    WHEN billing_amount = '$0.0000' THEN 'zero amount'
    WHEN contains(billing_amount, 'JPY.') OR contains(billing_amount, '£') OR contains(billing_amount, '€') THEN 'foreign amount'
    WHEN contains(institution, 'NATION_24') THEN 'internal account'
    WHEN billing_amount IS NULL OR contains(billing_amount, ' net') THEN 'unreadable amount'
    WHEN bad_time IS NOT NULL THEN 'unreadable time' ELSE 'kept' END AS fate,
    CASE WHEN contains(billing_amount, ' net') THEN NULL
      WHEN contains(billing_amount, 'AU') THEN round_even(TRY_CAST(substr(billing_amount, 4) AS DOUBLE) * 0.69 * 10000, 0) / 10000
      ELSE round_even(TRY_CAST(substr(billing_amount, 2) AS DOUBLE) * 10000, 0) / 10000 END AS amount
  FROM export
)"""


def _audit(shape: str = "FALSE") -> str:
    known = f"NOT ({shape}) AND fate <> 'foreign amount'"
    return f"""WITH {_export(shape)} SELECT fate, count(*) AS orders,
  round(coalesce(sum(CASE WHEN {known} THEN amount END), 0), 4) AS revenue FROM fates GROUP BY fate"""


ORACLE: dict[str, str] = {
    "clean_status_rules": f"WITH {RAW} SELECT order_id, lob_type, order_status, quotation_number FROM raw "
    f"WHERE {STATUS_OK}",
    "clean_territory": f"WITH {RAW} SELECT order_id, territory FROM raw WHERE {TERRITORY_OK}",
    "clean_amounts": f"WITH {RAW} SELECT order_id, {AMOUNT} AS billing_amount FROM raw WHERE {AMOUNT_OK}",
    "clean_internal_accounts": f"""WITH {RAW}
SELECT order_id, institution, {REMAP} AS lob_type FROM raw
WHERE NOT regexp_matches(institution, 'NATION_24') AND NOT regexp_matches(customer_email, '9.9$')
  AND NOT regexp_matches(customer_email, '#0+1.7')""",
    "clean_all_rules": f"WITH {CLEAN} SELECT * FROM clean",
    "null_safe_exclusion": f"""WITH {RAW} SELECT promotion_code, count(*) AS orders FROM raw
WHERE promotion_code IS NULL OR promotion_code NOT IN ('FLASH-0','NGS-5') GROUP BY promotion_code""",
    "enrich_lob_key": f"""WITH {RAW}
SELECT order_id, lower(customer_email) AS customer_email,
  CASE WHEN lob_type IN ('L6','L7') THEN lob_type ELSE 'c' || substr(lob_type, 2) END AS lob,
  lower(customer_email || '*' || CASE WHEN lob_type IN ('L6','L7') THEN lob_type
    ELSE 'c' || substr(lob_type, 2) END) AS email_lob
FROM raw""",
    "order_flags": f"""WITH {SALES}
SELECT order_id, quote_based, confirmed AS confirmed_by_quote, {CONFIRMED2} AS confirmed FROM sales""",
    "scope_filter": f"WITH {SALES} SELECT order_id, lob, priority FROM sales WHERE {IN_SCOPE}",
    "eligibility_unpivot": f"""WITH {SALES}, {SHIP}
SELECT campaign, order_type, count(*) AS orders, round(sum(billing_amount), 4) AS revenue
FROM sales JOIN elig USING (order_type) GROUP BY campaign, order_type""",
    "list_attribution": f"WITH {FLASH} SELECT order_id, recent_open, confirmed, billing_amount FROM labelled",
    "list_attribution_fanout": f"""WITH {FLASH}
SELECT campaign AS recent_open, count(customer_email) AS "# of Order",
  round(sum(billing_amount), 4) AS "Revenue", count(DISTINCT customer_email) AS "# of unique customers"
FROM flash JOIN lists ON customer_email = recipient GROUP BY campaign""",
    "click_attribution": f"""WITH {FLASH}
SELECT order_id, campaign AS recent_open, billing_amount FROM flash
JOIN (SELECT DISTINCT campaign, recipient FROM lists WHERE clicked) ON customer_email = recipient""",
    "touch_matrix": f"""WITH {PLAIN}, {SHIP}
SELECT order_id, {', '.join(f"(SELECT max(sent_at) FROM ship WHERE recipient = customer_email AND campaign = '{c}') AS {c}" for c in SHIP_NAMES)}
FROM plain""",
    "window_attribution_lob": _window("lob_type IN ('L2','L3')", "lob"),
    "window_attribution_priority": _window("priority IN ('1-URGENT')", "priority"),
    "windows_of_index": f"WITH {MANY} SELECT order_id, recent_open, created_date, lob FROM labelled",
    "windows_of_weeks": f"""WITH {EVENT_TOUCHES},
win AS (SELECT campaign, TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(2 * pos AS INTEGER)) AS start FROM ep)
SELECT campaign AS recent_open, count(*) AS orders, round(sum(CAST(value AS DECIMAL(18,4))), 4)::DOUBLE AS revenue
FROM events JOIN win ON ts >= start AND ts <= start + INTERVAL 3 DAY WHERE event_type = 'purchase' GROUP BY campaign""",
    "latest_touch": f"WITH {PLAIN}, {SHIP}, {_ranked('plain', 'ship', SHIP_PAIRS)} "
    "SELECT order_id, recent_open FROM labelled",
    "latest_touch_events": f"WITH {EVENT_TOUCHES}, {_ranked('eo', 'et', 'ep')} "
    "SELECT order_id, recent_open FROM labelled",
    "latest_touch_complete": f"""WITH {TOUCH}
SELECT c.order_id, c.order_type, CASE WHEN c.order_type NOT IN (SELECT order_type FROM elig) THEN NULL
  ELSE coalesce(l.recent_open, 'none_open') END AS recent_open
FROM cur c LEFT JOIN labelled l ON l.order_id = c.order_id
WHERE c.customer_email IN (SELECT recipient FROM ship)""",
    "new_to_company": f"WITH {FLASH_FLAGGED} "
    "SELECT order_id, recent_open, new_to_company, new_to_lob FROM flagged",
    "known_by_history": f"""WITH {FLASH_FLAGGED}
SELECT recent_open, new_to_company, new_to_lob, count(*) AS orders FROM flagged
GROUP BY recent_open, new_to_company, new_to_lob""",
    "clean_rejects": f"""WITH {RAW}
SELECT order_id, amount AS billing_amount FROM (
  SELECT *, CASE WHEN order_id % 13 <> 0 THEN
    CASE WHEN order_id % 11 = 0 THEN billing_amount || ' net' ELSE billing_amount END END AS amount FROM raw
) WHERE {STATUS_OK} AND {TERRITORY_OK} AND NOT contains(institution, 'NATION_24')
  AND (amount IS NULL OR (order_id % 11 = 0 AND NOT contains(amount, 'JPY.') AND NOT contains(amount, '£')
    AND NOT contains(amount, '€')))""",
    "clean_report": f"""WITH {RAW}, priced AS (
  SELECT lob_type, {AMOUNT} AS billing_amount FROM raw
  WHERE {STATUS_OK} AND {TERRITORY_OK} AND {AMOUNT_OK} AND NOT contains(institution, 'NATION_24')
)
SELECT 'Cleaned' AS stage, lob_type, count(*) AS orders, round(sum(billing_amount), 4) AS revenue
FROM priced GROUP BY lob_type
UNION ALL
SELECT 'Ready', {REMAP}, count(*), round(sum(billing_amount), 4) FROM priced GROUP BY {REMAP}""",
    "customers_by_sets": f"""WITH {TOUCH}, named AS (SELECT l.*, combined_name FROM labelled l JOIN idx ON campaign = recent_open)
SELECT 'campaign' AS level, recent_open AS key, count(DISTINCT customer_email) AS customers,
  count(DISTINCT CASE WHEN priority = '1-URGENT' THEN customer_email END) AS urgent FROM named GROUP BY recent_open
UNION ALL SELECT 'combined', combined_name, count(DISTINCT customer_email),
  count(DISTINCT CASE WHEN priority = '1-URGENT' THEN customer_email END) FROM named GROUP BY combined_name
UNION ALL SELECT 'total', NULL, count(DISTINCT customer_email),
  count(DISTINCT CASE WHEN priority = '1-URGENT' THEN customer_email END) FROM named""",
    "metrics_in_sql": f"""WITH {FLASH_FLAGGED}
SELECT recent_open, lob_type, count(*) AS orders, round(sum(billing_amount), 4) AS revenue,
  round(sum(CASE WHEN confirmed = 'confirmed' THEN billing_amount ELSE 0 END), 4) AS confirmed_revenue,
  count(DISTINCT customer_email) AS customers, count(DISTINCT CASE WHEN new_to_company = 1 THEN customer_email END) AS new_customers
FROM flagged GROUP BY recent_open, lob_type""",
    "cleaning_audit": _audit(),
    "rejects_by_reason": f"""WITH {_export()} SELECT order_id, fate AS reason, billing_amount, bad_time FROM fates
WHERE fate IN ('unreadable amount', 'unreadable time')""",
    "export_read_back": _audit("order_id % 23 = 0 OR order_id % 29 = 0"),
    "one_list_read_back": """SELECT 'mine' AS campaign, printf('customer#%09d', user_id) AS recipient,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS sent_at, count(*) AS listings, count(*) FILTER (value > 250) AS clicks
FROM events WHERE event_type = 'click' GROUP BY ALL""",
    "flash_all_orders": f"WITH {FLASH} "
    "SELECT order_id, lower(promotion_code) AS promotion_code, confirmed, billing_amount FROM flash",
    "flash_clicked": f"""WITH {FLASH}
SELECT order_id, campaign AS recent_open, billing_amount FROM flash
JOIN (SELECT DISTINCT campaign, recipient FROM lists WHERE clicked) ON customer_email = recipient""",
    "flash_customers": f"""WITH {FLASH_FLAGGED}
SELECT DISTINCT 'New to Company' AS "New Customer Type", customer_email AS "Customer Email",
  user_name AS "Customer Name", institution AS "Institution", 'Flash' AS "Campaign Source",
  lob AS "First Order LoB"
FROM flagged WHERE new_to_company = 1
UNION
SELECT DISTINCT 'New to ' || lob, customer_email, user_name, institution, 'Flash', 'N/A'
FROM flagged WHERE new_to_lob = 1""",
    "research_fanout": _report(
        f"""{TOUCH_FLAGGED.replace("labelled AS (", "credited AS (", 1)}""".replace(
            "SELECT o.*, t.campaign AS recent_open,", "SELECT o.*, t.campaign AS recent_open, t.sent_at,"
        ).replace(
            "flagged0 AS (",
            """labelled AS (
  SELECT c.* EXCLUDE (sent_at) FROM credited c
  JOIN ship t ON t.campaign = c.recent_open AND t.recipient = c.customer_email AND t.sent_at = c.sent_at
),
flagged0 AS (""",
            1,
        ),
        BUNDLE,
        SHIP_NAMES,
    ),
    "regional_orders": f"WITH {REGION_FLAGGED} "
    "SELECT order_id, recent_open, new_to_company, new_to_lob FROM flagged WHERE lob_type IN ('L2','L3')",
    "regions_orders": f"WITH {MANY_FLAGGED} SELECT order_id, recent_open, new_to_company, new_to_lob FROM flagged",
    "regions_metrics": _report(
        MANY_FLAGGED,
        ['count(customer_email) AS "# of Order"', 'round(sum(billing_amount), 4) AS "Revenue"']
        + _status(ANY_LINE)
        + _acquired(ANY_LINE)
        + UNIQUE,
        SHIP_NAMES,
    ),
    "regions_customers": f"""WITH {MANY_FLAGGED}
SELECT DISTINCT 'New to Company' AS "New Customer Type", customer_email AS "Customer Email",
  user_name AS "Customer Name", institution AS "Institution", recent_open AS "Campaign Source",
  lob AS "First Order LoB"
FROM flagged WHERE new_to_company = 1
UNION
SELECT DISTINCT 'New to ' || lob, customer_email, user_name, institution, recent_open, 'N/A'
FROM flagged WHERE new_to_lob = 1""",
    "regional_metric_rows": f"""WITH {REGION_FLAGGED},
one AS (
  SELECT count(customer_email) AS "# of Order", round(sum(billing_amount), 4) AS "Revenue",
    {', '.join(_status(ANY_LINE) + _acquired(ANY_LINE) + UNIQUE)}
  FROM flagged WHERE lob_type IN ('L2','L3')
),
rows AS (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM one) ON COLUMNS(*) INTO NAME metric VALUE value)
SELECT CAST(list_position([{', '.join(repr(n) for n in REGIONAL_NAMES)}], metric) - 1 AS INTEGER) AS pos, metric, value
FROM rows""",
    "new_to_lob": f"WITH {TOUCH_FLAGGED} SELECT order_id, recent_open, new_to_company, new_to_lob FROM flagged",
    "flash_metrics": _report(FLASH_FLAGGED, BUNDLE, ["click", "view", "newsletter"]),
    "research_metrics": _report(TOUCH_FLAGGED, BUNDLE, SHIP_NAMES),
    "combined_metrics": _report(TOUCH_FLAGGED, BUNDLE, ["ship_an", "ship_r"], key="combined_email"),
    "metrics_by_level": _levels(TOUCH_FLAGGED, BUNDLE),
    "promo_by_level": _levels(
        PROMO_FLAGGED.replace("'ship_an'", "'early'").replace("'ship_r'", "'late'"),
        CONFIRMED_ALL + _status(ANY_LINE) + _acquired(ANY_LINE) + UNIQUE,
    ),
    "quote_metrics": _report(TOUCH, _quote(["L0", "L1", "L2", "L3"]), SHIP_NAMES, "labelled"),
    "direct_metrics": _report(TOUCH, _direct(), SHIP_NAMES, "labelled"),
    "status_metrics": _report(TOUCH_FLAGGED, _status(LINE_CASES), SHIP_NAMES),
    "new_customers_by_lob": _report(TOUCH_FLAGGED, _acquired(LINE_CASES), SHIP_NAMES),
    "unique_customers": _report(TOUCH, UNIQUE, SHIP_NAMES, "labelled"),
    "promo_metrics": _report(
        PROMO_FLAGGED, CONFIRMED_ALL + _status(ANY_LINE) + _acquired(ANY_LINE) + UNIQUE, SHIP_NAMES
    ),
    "promo_combined": _report(
        PROMO_FLAGGED.replace("'ship_an'", "'early'").replace("'ship_r'", "'late'"),
        CONFIRMED_ALL + _status(ANY_LINE) + _acquired(ANY_LINE) + UNIQUE,
        ["early", "late"],
        key="combined_email",
    ),
    "promo_lob_detail": _report(PROMO, _quote(["L1", "L3"], "Order"), SHIP_NAMES, "labelled"),
    "promo_revenue_split": _report(
        PROMO,
        [
            'round(sum(billing_amount), 4) AS "AllRevenue"',
            _sum("promotion_code IS NOT NULL", "WithPromoCode"),
        ],
        SHIP_NAMES,
        "labelled",
    ),
    "revenue_by_code": f"""WITH {PROMO}
SELECT promotion_code, round(sum(billing_amount), 4) AS "AllRevenue" FROM labelled
WHERE promotion_code = 'NGS-3' OR promotion_code = 'NGS-4' OR promotion_code = 'FLASH-1'
GROUP BY promotion_code""",
    "regional_metrics": f"""WITH {REGION_FLAGGED}
SELECT count(customer_email) AS "# of Order", round(sum(billing_amount), 4) AS "Revenue",
  {', '.join(_status(ANY_LINE) + _acquired(ANY_LINE) + UNIQUE)}
FROM flagged WHERE lob_type IN ('L2','L3')""",
    "revenue_breakdown": _breakdown(),
    "new_customer_list": f"""WITH {TOUCH_FLAGGED}
SELECT DISTINCT 'New to Company' AS "New Customer Type", customer_email AS "Customer Email",
  user_name AS "Customer Name", institution AS "Institution", combined_email AS "Campaign Source",
  lob AS "First Order LoB"
FROM flagged WHERE new_to_company = 1
UNION
SELECT DISTINCT 'New to ' || lob, customer_email, user_name, institution, combined_email, 'N/A'
FROM flagged WHERE new_to_lob = 1""",
}
ORACLE["lists_read_back"] = ORACLE["latest_touch"]
ORACLE["published_complete"] = ORACLE["latest_touch_complete"]
ORACLE["published_levels"] = ORACLE["metrics_by_level"]
ORACLE["known_by_batches"] = ORACLE["known_by_history"]
ORACLE["list_attribution_prefiltered"] = ORACLE["list_attribution"]
