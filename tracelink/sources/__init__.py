"""Domain views over the driver's tables. Each is one projection that Spark and any SQL engine can write alike.

A template names its inputs in braces; `<<a ## b>>` holds Spark's spelling and the other engine's.
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FIRST = "'Rajesh Priya  Amit   Neha   Vikram Anita  Suresh Kavita Arjun  Meera  Rohan  Divya  Karan  Pooja  Nitin  Sunita Manish Rekha  Ashok  Geeta  '"
LAST = "'Kumar  Sharma Verma  Singh  Patel  Gupta  Reddy  Nair   Iyer   Mehta  Joshi  Rao    Das    Bose   Khan   Shaikh Pillai Menon  Kapoor Malik  Saxena Bhatt  Chopra Sinha  Thakur '"

# Fields, their labels, and spellings of a column's header that stand for each.
FIELDS = {
    "fir_id": ("fir / case id", ["fir_id", "fir", "fir no", "fir no.", "fir number", "fir_number", "case number", "case no", "case no.", "case_id", "case id", "caseno", "crime number"]),
    "person_id": ("person id", ["person_id", "person id", "accused_id", "suspect_id"]),
    "name": ("person", ["name", "person", "person name", "suspect name", "suspect", "accused", "accused name", "full name"]),
    "phone": ("phone", ["phone", "phone number", "mobile", "mobile no", "mobile no.", "mobile number", "contact", "contact no", "msisdn"]),
    "vehicle_no": ("vehicle", ["vehicle_no", "vehicle no", "vehicle number", "vehicle registration", "registration no", "registration number", "reg no", "vahan", "vehicle"]),
    "bank_account": ("bank account", ["bank_account", "bank account", "account", "account no", "a/c"]),
    "social_id": ("social account", ["social_id", "social", "handle"]),
    "jurisdiction": ("jurisdiction", ["jurisdiction", "district", "ps", "police station"]),
    "home_city": ("home city", ["home_city", "home city", "city"]),
    "location": ("location", ["location", "place", "scene", "incident location"]),
    "date": ("event date", ["date", "incident date", "event date", "fir date", "occurrence date"]),
    "crime": ("crime / offence", ["crime", "offence", "offense", "ipc", "charge"]),
    "vehicle_type": ("vehicle type", ["vehicle_type", "vehicle type"]),
    "registered_city": ("vehicle registered city", ["registered_city", "registered city"]),
    "risk_group": ("risk group", ["risk_group", "risk group", "risk"]),
    "narrative_text": ("narrative / notes", ["narrative_text", "narrative", "text", "statement"]),
    "source_ref": ("source reference", ["source_ref", "source ref", "source", "document id"]),
}
_PAIRS = sorted({("".join(c for c in spelling if c.isalnum()), field) for field, (_, spellings) in FIELDS.items() for spelling in spellings})

# What identifiers and entities look like in text (braces doubled for the templates), in the oracle's spelling.
PHONE, NOT_A_PHONE = r"(?:\+91[-\s]?\d{{5}}[-\s]?\d{{5}}|\+91[-\s]?\d{{10}}|\b[6-9]\d{{9}}\b)", r"(?i)\b(?:case|fir|crime|dated|date|no\.?|number|ref)\b"
VEHICLE, IFSC = r"(?i)\b[A-Z]{{2}}\d{{2}}[A-Z]{{1,3}}\d{{4}}\b", r"(?i)\b[A-Z]{{4}}0[A-Z0-9]{{6}}\b"
ACCOUNT, NUMBER, ACCOUNT_BEFORE = r"(?i)\bACC\d{{6,}}\b", r"\b\d{{9,18}}\b", r"(?i)\b(?:account|a/c|acct|bank\s+account)\b"
ENTITIES = (
    ("person", r"\b(?:Complainant|Accused|Witness|Suspect|named|states\s+that)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"),
    ("location", r"\b(?:in|at|near|from)\s+([A-Z][A-Za-z0-9][A-Za-z0-9\s\-]{{1,38}}[A-Za-z0-9])"),
    ("organisation", r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Police|Logistics|Bank|Corporation|Ltd\.?|Limited))\b"),
    ("event", r"(?i)\b(robbery(?:\s+event)?|cyber crime|organized crime|organised crime|theft|fraud|murder|assault|extortion)\b"),
    ("event", r"(?i)\b(FIR(?:\sNO\.?|\s|/|-)\s*[A-Z]{{0,3}}[\s/\-]*\d{{4}}[\s/\-]*\d+|FIR\d{{5,}})\b"),
)


def spans(view: str, pattern: str, more: str = "") -> str:
    """Oracle SQL: the matches of a pattern in a view's text with their places; texts between matches and the matches before add up."""
    kept = f"source_ref, text{', ' + more if more else ''}"
    return f"""
        SELECT {kept}, found[k] AS value, CAST(coalesce(list_sum(list_transform(between[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS starts
        FROM (SELECT {kept}, found, between, unnest(range(1, len(found) + 1)) AS k
              FROM (SELECT {kept}, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS between FROM {{{view}}}) a) b"""


# an import's date: ISO as it stands, else the first form that fits, with the day first
_FORMS = (("d-M-yyyy", "%d-%m-%Y"), ("d/M/yyyy", "%d/%m/%Y"), ("d.M.yyyy", "%d.%m.%Y"), ("yyyy/M/d", "%Y/%m/%d"), ("M/d/yyyy", "%m/%d/%Y"), ("d MMM yyyy", "%d %b %Y"), ("d MMMM yyyy", "%d %B %Y"))
_IMPORTED = "<<CASE WHEN {0} RLIKE '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$' THEN try_to_date({0}, 'yyyy-MM-dd') ELSE coalesce(" + ", ".join(f"try_to_date({{0}}, '{a}')" for a, _ in _FORMS) + ") END ## CASE WHEN regexp_full_match({0}, '[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}') THEN try_cast({0} AS DATE) ELSE coalesce(" + ", ".join(f"CAST(try_strptime({{0}}, '{b}') AS DATE)" for _, b in _FORMS) + ") END>>"
_SECOND = "<<date_format({0}, 'yyyy-MM-dd HH:mm:ss') ## strftime({0}, '%Y-%m-%d %H:%M:%S')>>"
# the sound of a word for an engine without the function: codes of the letters, none for h and w, runs of one code once, vowels left out
_CODES = "CASE WHEN upper(left(word, 1)) IN ('H', 'W') THEN '7' ELSE '' END || translate(upper(word), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '111122222222334556000000')"
for _digit in "123456":
    _CODES = f"regexp_replace({_CODES}, '{_digit}+', '{_digit}', 'g')"
_SOUNDEX = f"<<soundex(word) ## upper(left(word, 1)) || left(replace(substr({_CODES}, 2), '0', '') || '000', 3)>>"

BINDINGS = {
    "persons": f"""
        SELECT 'P' || CAST(c_custkey AS STRING) AS person_id,
               trim(substr({FIRST}, CAST(1 + (c_custkey % 20) * 7 AS INT), 7)) || ' ' || trim(substr({LAST}, CAST(1 + (CAST(floor(c_custkey / 20) AS BIGINT) % 25) * 7 AS INT), 7)) AS name,
               '+91-90000-' || lpad(CAST(10000 + c_custkey % 1200 AS STRING), 5, '0') AS phone,
               'DL11AB' || lpad(CAST(c_custkey % 1400 AS STRING), 4, '0') AS vehicle_no,
               'ACC' || lpad(CAST(100000 + c_custkey % 1450 AS STRING), 6, '0') AS bank_account,
               'user_' || CAST(c_custkey AS STRING) AS social_id, n_name AS home_city, c_mktsegment AS risk_group, c_custkey AS ord
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "vehicles": "SELECT person_id, vehicle_no, home_city AS registered_city, CASE WHEN ord % 2 = 0 THEN 'Car' ELSE 'Motorcycle' END AS vehicle_type FROM {persons}",
    "calls_base": "SELECT event_id, ts, value, event_type, 'P' || CAST(user_id AS STRING) AS a, 'P' || regexp_extract(props, '([0-9]+)', 1) AS b, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}",
    "cdr": "SELECT event_id, a AS caller_id, b AS receiver_id, ts AS timestamp, CAST(floor(value) AS BIGINT) AS duration_sec, CASE WHEN event_id % 2 = 0 THEN 'voice' ELSE 'sms' END AS call_type FROM {calls_base} WHERE event_type = 'click'",
    "finance": "SELECT event_id, a AS sender_id, b AS receiver_id, CAST(ts AS DATE) AS date, value AS amount FROM {calls_base} WHERE event_type = 'purchase'",
    "social": "SELECT event_id, a AS user_id, b AS connected_user_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'reply' WHEN event_id % 3 = 1 THEN 'retweet' ELSE 'mention' END AS interaction_type, CAST(ts AS DATE) AS date FROM {calls_base} WHERE event_type = 'view'",
    "surveillance": "SELECT 'S' || CAST(event_id AS STRING) AS event_id, a AS person_id, n_name AS location, ts AS timestamp, CASE event_id % 4 WHEN 0 THEN 'vehicle movement' WHEN 1 THEN 'meeting' WHEN 2 THEN 'atm visit' ELSE 'border crossing' END AS event_type, event_id AS ord FROM {calls_base} c JOIN {nation} n ON c.k % 25 = n.n_nationkey WHERE c.event_type = 'error'",
    "fir": "SELECT 'FIR' || CAST(event_id AS STRING) AS fir_id, a AS person_id, CASE k % 5 WHEN 0 THEN 'Fraud' WHEN 1 THEN 'Theft' WHEN 2 THEN 'Cyber Crime' WHEN 3 THEN 'Assault' ELSE 'Smuggling' END AS crime, CAST(ts AS DATE) AS date, n_name AS location, event_id AS ord FROM {calls_base} c JOIN {nation} n ON c.k % 25 = n.n_nationkey WHERE c.event_type = 'signup'",
    "cases": "SELECT 'FIR' || CAST(o_orderkey AS STRING) AS fir_id, 'P' || CAST(o_custkey AS STRING) AS person_id, CASE o_orderkey % 4 WHEN 0 THEN 'Cyber Crime' WHEN 1 THEN 'cyber-crime' WHEN 2 THEN 'cybercrime' ELSE lower(o_orderpriority) END AS crime, CAST(o_orderdate AS DATE) AS date, n_name AS location, o_orderkey AS ord FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    # prose with +91 and bare numbers, numbers that are no phones, and accounts of both kinds
    "narratives": """
        SELECT c.fir_id AS source_ref, c.location AS jurisdiction, CAST(c.date AS STRING) AS event_date, c.ord,
               CASE WHEN c.ord % 7 = 0 THEN 'Case No. ' || substr(p.phone, 5, 5) || substr(p.phone, 11, 5) || ' was registered.'
                    WHEN c.ord % 7 = 1 THEN 'Suspect called from ' || substr(p.phone, 5, 5) || substr(p.phone, 11, 5) || ' near the toll.'
                    ELSE 'Suspect called from ' || p.phone || ' near the toll.' END
               || ' Vehicle ' || CASE WHEN c.ord % 4 = 0 THEN lower(p.vehicle_no) ELSE p.vehicle_no END || ' was seen; paid via HDFC0001234 from account '
               || CASE WHEN c.ord % 6 = 2 THEN '1122' || substr(p.bank_account, 4) ELSE p.bank_account END || '.'
               || CASE WHEN c.ord % 3 = 0 THEN ' The matter was dated ' || CAST(c.date AS STRING) || '.' ELSE '' END AS text
        FROM {cases} c JOIN {persons} p ON c.person_id = p.person_id""",
    "entity_mapping": "SELECT person_id AS entity_id, 'phone' AS entity_type, phone AS source_id, 'crm' AS source, ord FROM {persons} UNION ALL SELECT person_id, 'vehicle', vehicle_no, 'rto', ord FROM {persons} UNION ALL SELECT person_id, 'bank_account', bank_account, 'bank', ord FROM {persons} UNION ALL SELECT 'P' || CAST(ord + 1 AS STRING), 'phone', phone, 'crm', ord + 1000000000 FROM {persons} WHERE ord % 11 = 0",
    "edges": """
        SELECT src_rank * 1000000000000 + ord AS edge_id, source, target, relationship, seen_at, amount, duration FROM (
          SELECT 1 AS src_rank, p.ord, p.person_id AS source, p.vehicle_no AS target, 'OWNS' AS relationship, CAST(NULL AS TIMESTAMP) AS seen_at, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS BIGINT) AS duration FROM {persons} p
          UNION ALL SELECT 2, event_id, caller_id, receiver_id, 'CALLED', CAST(timestamp AS TIMESTAMP), CAST(NULL AS DOUBLE), duration_sec FROM {cdr}
          UNION ALL SELECT 3, event_id, sender_id, receiver_id, 'TRANSFERRED_MONEY', CAST(date AS TIMESTAMP), amount, CAST(NULL AS BIGINT) FROM {finance}
          UNION ALL SELECT 4, ord, person_id, fir_id, 'INVOLVED_IN', CAST(date AS TIMESTAMP), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM {fir}
          UNION ALL SELECT 5, event_id, user_id, connected_user_id, 'SOCIAL_' || upper(coalesce(interaction_type, 'unknown')), CAST(date AS TIMESTAMP), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM {social}
          UNION ALL SELECT 6, ord, person_id, event_id, 'OBSERVED_AT', CAST(timestamp AS TIMESTAMP), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM {surveillance}) e
        WHERE source IS NOT NULL AND target IS NOT NULL""",
    "nodes": """
        SELECT id, max(entity_type) AS entity_type FROM (
          SELECT person_id AS id, 'person' AS entity_type FROM {persons} UNION ALL SELECT vehicle_no, 'vehicle' FROM {vehicles}
          UNION ALL SELECT fir_id, 'crime_event' FROM {fir} UNION ALL SELECT event_id, 'surveillance_event' FROM {surveillance}
          UNION ALL SELECT source, CAST(NULL AS STRING) FROM {edges} UNION ALL SELECT target, CAST(NULL AS STRING) FROM {edges}) n GROUP BY id""",
    "ends": "SELECT source AS id, target AS other, relationship, edge_id, seen_at, amount, duration FROM {edges} UNION ALL SELECT target, source, relationship, edge_id, seen_at, amount, duration FROM {edges}",
    "person_edges": "SELECT edge_id, source, target, relationship, seen_at FROM {edges} WHERE relationship IN ('CALLED', 'TRANSFERRED_MONEY') OR relationship LIKE 'SOCIAL_%'",
    "activity": "SELECT id AS person_id, count_if(relationship = 'CALLED') AS communications, count_if(relationship = 'TRANSFERRED_MONEY') AS transfers, count_if(relationship LIKE 'SOCIAL_%') AS social, count_if(relationship = 'OBSERVED_AT') AS observations, count_if(relationship = 'INVOLVED_IN' AND target NOT LIKE 'S%') AS cases, count_if(relationship = 'INVOLVED_IN' AND target LIKE 'S%') AS surveillance FROM (SELECT relationship, target, EXPLODE(<<array(source, target) ## list_value(source, target)>>) AS id FROM {edges}) e WHERE id LIKE 'P%' GROUP BY id",
    # a table of centralities for the risk score to join; stand-ins that any engine can compute: the share of a walk's steps, and of pairs of nodes, that a person joins
    "centrality": "SELECT id AS person_id, CAST(k * (k - 1) AS DOUBLE) / greatest(1, n * (n - 1)) AS betweenness, CAST(d AS DOUBLE) / total AS pagerank FROM (SELECT id, count(DISTINCT other) AS k, count(*) AS d FROM {ends} WHERE id LIKE 'P%' GROUP BY id) p CROSS JOIN (SELECT count(DISTINCT id) AS n, count(*) AS total FROM {ends}) t",
    "risk_inputs": "SELECT a.*, coalesce(c.betweenness, 0.0) AS betweenness, coalesce(c.pagerank, 0.0) AS pagerank FROM {activity} a LEFT JOIN {centrality} c ON a.person_id = c.person_id",
    # for the oracle; Spark takes operators.extraction.mentions
    "mentions": f"""
        SELECT DISTINCT source_ref, jurisdiction, event_date, entity_type, value FROM (
          SELECT source_ref, jurisdiction, event_date, 'phone' AS entity_type, '+91' || right(regexp_replace(value, '[^0-9]', '', 'g'), 10) AS value FROM ({spans('narratives', PHONE, 'jurisdiction, event_date')}) s
          WHERE NOT regexp_matches(right(left(text, starts), 32), '{NOT_A_PHONE}') AND NOT regexp_matches(right(left(text, starts), 1) || '.' || substr(text, starts + length(value) + 1, 1), '[0-9]')
          UNION ALL SELECT source_ref, jurisdiction, event_date, 'vehicle', upper(value) FROM ({spans('narratives', VEHICLE, 'jurisdiction, event_date')}) s
          UNION ALL SELECT source_ref, jurisdiction, event_date, 'bank_account', upper(value) FROM ({spans('narratives', ACCOUNT, 'jurisdiction, event_date')}) s
          UNION ALL SELECT source_ref, jurisdiction, event_date, 'bank_account', value FROM ({spans('narratives', NUMBER, 'jurisdiction, event_date')}) s WHERE regexp_matches(right(left(text, starts), 48), '{ACCOUNT_BEFORE}')
          UNION ALL SELECT source_ref, jurisdiction, event_date, 'ifsc', upper(value) FROM ({spans('narratives', IFSC, 'jurisdiction, event_date')}) s) m""",
    "registry": "SELECT DISTINCT entity_type, CASE WHEN entity_type = 'phone' THEN '+91' || regexp_replace(substr(source_id, 4, 12), '[^0-9]', '', 'g') ELSE upper(source_id) END AS value, entity_id FROM {entity_mapping}",
    "resolved": "SELECT m.source_ref, m.jurisdiction, m.event_date, m.entity_type, m.value, r.owners, CASE WHEN m.entity_type = 'ifsc' OR r.owners IS NULL THEN 'unresolved' WHEN r.owners = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN r.owners = 1 THEN r.entity_id END AS entity_id, CASE WHEN r.owners IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM {mentions} m LEFT JOIN (SELECT entity_type, value, count(*) AS owners, min(entity_id) AS entity_id FROM {registry} GROUP BY entity_type, value) r ON m.entity_type = r.entity_type AND m.value = r.value",
    "anomaly": """
        SELECT person_id, communications, transfers, social, observations, s1, s2, s3, s4,
               CAST(<<bround ## round_even>>(100 * coalesce((.25 * s1 + .30 * s2 + .20 * s3 + .25 * s4) / nullif(w, 0), 0), 0) AS BIGINT) AS anomaly_score
        FROM (SELECT a.*, CASE WHEN x1 > 0 THEN .25 ELSE 0 END + CASE WHEN x2 > 0 THEN .30 ELSE 0 END + CASE WHEN x3 > 0 THEN .20 ELSE 0 END + CASE WHEN x4 > 0 THEN .25 ELSE 0 END AS w, round(CASE WHEN communications <= m1 THEN 0 WHEN d1 > 0 THEN least(1, .6745 * (communications - m1) / d1 / 3.5) ELSE (communications - m1) / (x1 - m1) END, 4) AS s1,
                     round(CASE WHEN transfers <= m2 THEN 0 WHEN d2 > 0 THEN least(1, .6745 * (transfers - m2) / d2 / 3.5) ELSE (transfers - m2) / (x2 - m2) END, 4) AS s2,
                     round(CASE WHEN social <= m3 THEN 0 WHEN d3 > 0 THEN least(1, .6745 * (social - m3) / d3 / 3.5) ELSE (social - m3) / (x3 - m3) END, 4) AS s3,
                     round(CASE WHEN observations <= m4 THEN 0 WHEN d4 > 0 THEN least(1, .6745 * (observations - m4) / d4 / 3.5) ELSE (observations - m4) / (x4 - m4) END, 4) AS s4
              FROM {activity} a CROSS JOIN (
                SELECT max(m1) AS m1, max(m2) AS m2, max(m3) AS m3, max(m4) AS m4, max(communications) AS x1, max(transfers) AS x2, max(social) AS x3, max(observations) AS x4,
                       median(abs(communications - m1)) AS d1, median(abs(transfers - m2)) AS d2, median(abs(social - m3)) AS d3, median(abs(observations - m4)) AS d4
                FROM {activity} CROSS JOIN (SELECT median(communications) AS m1, median(transfers) AS m2, median(social) AS m3, median(observations) AS m4 FROM {activity}) m) d) z""",
    "uploads": "SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN 'FIR' || CAST(o_orderkey - 1 AS STRING) ELSE ' FIR-N' || CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) || ' ' END AS fir_id, CASE WHEN o_orderkey % 10 = 0 THEN 'nan' ELSE c_name END AS name, CASE WHEN o_orderkey % 8 = 0 THEN 'not-a-phone' WHEN o_orderkey % 8 = 1 THEN '+91 9' || lpad(CAST(o_custkey AS STRING), 9, '0') WHEN o_orderkey % 8 = 2 THEN '9' || lpad(CAST(o_custkey AS STRING), 4, '0') || '-00000' ELSE '9' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS phone, CASE o_orderkey % 3 WHEN 0 THEN <<date_format(o_orderdate, 'dd/MM/yyyy') ## strftime(o_orderdate, '%d/%m/%Y')>> WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE <<date_format(o_orderdate, 'dd.MM.yyyy') ## strftime(o_orderdate, '%d.%m.%Y')>> END END AS date, n_name AS jurisdiction FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "clean_uploads": f"""
        SELECT row_no, CASE WHEN lower(trim(fir_id)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim(fir_id) END AS fir_id, CASE WHEN lower(trim(name)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim(name) END AS name,
               CASE WHEN length(digits) = 10 OR length(digits) >= 12 AND substr(digits, 1, 2) = '91' THEN '+91' || right(digits, 10) END AS phone_norm, phone, date, {_IMPORTED.format('trim(date)')} AS date_parsed, jurisdiction
        FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM {{uploads}}) u""",
    "assessed": """
        SELECT u.row_no, u.fir_id, u.name, u.phone, u.jurisdiction, u.date_parsed,
               CASE WHEN u.fir_id IS NULL AND u.name IS NULL THEN 'invalid' WHEN u.phone_norm IS NULL THEN 'invalid' WHEN k.fir_id IS NOT NULL THEN 'duplicate' WHEN u.n > 1 THEN 'duplicate' WHEN u.date_parsed IS NULL OR u.name IS NULL THEN 'incomplete' ELSE 'ready' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(fir_id, ''), coalesce(name, ''), coalesce(phone_norm, '') ORDER BY row_no) AS n FROM {clean_uploads}) u LEFT JOIN (SELECT DISTINCT fir_id FROM {cases}) k ON u.fir_id = k.fir_id""",
    "audit": "SELECT event_id, ts, 'user' || CAST(user_id AS STRING) AS user_id, event_type AS action, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'denied' ELSE 'failure' END AS result, CASE WHEN k % 10 = 0 THEN NULL ELSE 'J' || CAST(k % 9 AS STRING) END AS jurisdiction FROM (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e",
    "statements": "SELECT c.fir_id AS source_ref, c.location AS jurisdiction, 'Complainant ' || p.name || ' reported cyber crime near ' || p.home_city || '. Suspect sent money from ' || p.bank_account || ' to Northern Logistics after a Murderous fraud; the Fraud was seen by Northern Banking. See ' || c.fir_id || ' and ' || p.vehicle_no || '.' AS text FROM {cases} c JOIN {persons} p ON c.person_id = p.person_id",
    # for the oracle; Spark takes operators.extraction.entity_spans and identifier_spans
    "ner_spans": "SELECT DISTINCT source_ref, kind, value, ends - length(value) AS starts, ends FROM (" + " UNION ALL ".join(
        f"SELECT source_ref, '{kind}' AS kind, regexp_extract(value, '{pattern}', 1) AS value, starts + length(value) AS ends FROM ({spans('statements', pattern)}) s" for kind, pattern in ENTITIES
    ) + ") n",
    "identifier_spans": f"SELECT source_ref, value, starts, starts + length(value) AS ends FROM ({spans('statements', ACCOUNT)}) a UNION ALL SELECT source_ref, value, starts, starts + length(value) FROM ({spans('statements', VEHICLE)}) v",
    "confirmed": "SELECT entity_type, CASE WHEN entity_type = 'phone' THEN '+91' || regexp_replace(substr(source_id, 4, 12), '[^0-9]', '', 'g') ELSE upper(source_id) END AS value, max_by(entity_id, ord) AS entity_id FROM {entity_mapping} GROUP BY 1, 2",
    "name_mentions": "SELECT DISTINCT CASE ord % 3 WHEN 0 THEN name WHEN 1 THEN replace(name, 'ee', 'i') ELSE substr(name, 1, length(name) - 1) END AS mention FROM {persons}",
    "name_words": """
        SELECT DISTINCT mention AS name, 'mention' AS side, EXPLODE(<<split(mention, ' ') ## string_split(mention, ' ')>>) AS word FROM {name_mentions}
        UNION ALL SELECT DISTINCT name, 'name', EXPLODE(<<split(name, ' ') ## string_split(name, ' ')>>) FROM {persons}""",
    "name_keys": f"""
        SELECT DISTINCT name, side, 'w ' || lower(word) AS k FROM {{name_words}} WHERE word <> ''
        UNION SELECT name, side, 'p ' || lower(substr(word, 1, 3)) FROM {{name_words}} WHERE word <> ''
        UNION SELECT name, side, 's ' || {_SOUNDEX} FROM {{name_words}} WHERE word <> ''""",
    "name_blocks": "SELECT DISTINCT m.name AS mention, n.name FROM {name_keys} m JOIN {name_keys} n ON m.k = n.k WHERE m.side = 'mention' AND n.side = 'name'",
    "name_scores": "SELECT mention, name, CASE WHEN mention = name OR contains(' ' || name || ' ', ' ' || mention || ' ') OR contains(' ' || mention || ' ', ' ' || name || ' ') THEN 100.0 ELSE round(100 * <<jaro_winkler(mention, name) ## jaro_winkler_similarity(mention, name)>>, 4) END AS score FROM {name_blocks}",
    "name_ranked": "SELECT mention, name, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, name) AS k, lead(score) OVER (PARTITION BY mention ORDER BY score DESC, name) AS next_score FROM {name_scores} WHERE score >= 85",
    "aliases": f"SELECT * FROM (VALUES {', '.join(map(str, _PAIRS))}) AS a(compact, field)",
    "headers": """
        SELECT c_custkey AS file_id, 1 AS pos, CASE c_custkey % 4 WHEN 0 THEN 'FIR No.' WHEN 1 THEN ' Case-Number ' WHEN 2 THEN 'CaseNo' ELSE 'Ref & Page' END AS header FROM {customer}
        UNION ALL SELECT c_custkey, 2, CASE c_custkey % 3 WHEN 0 THEN 'Suspect Name' WHEN 1 THEN 'FULL_NAME' ELSE 'accused' END FROM {customer}
        UNION ALL SELECT c_custkey, 3, CASE c_custkey % 5 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Phone Number' WHEN 2 THEN 'contact no' WHEN 3 THEN 'Person' ELSE 'MSISDN' END FROM {customer}
        UNION ALL SELECT c_custkey, 4, CASE c_custkey % 2 WHEN 0 THEN 'Police Station' ELSE c_mktsegment END FROM {customer}
        UNION ALL SELECT c_custkey, 5, CASE c_custkey % 3 WHEN 0 THEN 'Vehicle Registraton' WHEN 1 THEN 'fir_id' ELSE 'Weapon' END FROM {customer}""",
    "header_fields": """
        SELECT file_id, pos, header, CASE WHEN k = 1 THEN field END AS field
        FROM (SELECT h.file_id, h.pos, h.header, a.field, row_number() OVER (PARTITION BY h.file_id, coalesce(a.field, h.header) ORDER BY h.pos) AS k
              FROM (SELECT file_id, pos, header, regexp_replace(replace(lower(header), '&', 'and'), '[^a-z0-9]+', '', 'g') AS compact FROM {headers}) h LEFT JOIN {aliases} a ON h.compact = a.compact) r""",
    "header_choices": "SELECT file_id, pos, CASE file_id % 6 WHEN 0 THEN 'unmapped' WHEN 1 THEN 'location' WHEN 2 THEN 'no_such_field' ELSE 'phone' END AS choice FROM {headers} WHERE pos = 1 + file_id % 4 AND file_id % 6 < 4",
    # the eight sources with all columns that the property graph reads, as text
    "graph_persons": "SELECT person_id, name, phone, vehicle_no, bank_account, social_id, home_city, risk_group, ord FROM {persons}",
    "graph_vehicles": "SELECT vehicle_no, person_id, registered_city, vehicle_type, CAST(substr(person_id, 2) AS BIGINT) AS ord FROM {vehicles}",
    "graph_entity_mapping": "SELECT entity_id, entity_type, source, source_id, ord FROM {entity_mapping}",
    "graph_cdr": f"""
        SELECT c.event_id AS ord, c.caller_id, c.receiver_id, {_SECOND.format('c.timestamp')} AS timestamp, CAST(c.duration_sec AS STRING) AS duration_sec, c.call_type, a.phone AS caller_phone,
               CASE WHEN c.event_id % 3 > 0 THEN b.phone END AS receiver_phone
        FROM {{cdr}} c LEFT JOIN {{persons}} a ON c.caller_id = a.person_id LEFT JOIN {{persons}} b ON c.receiver_id = b.person_id""",
    "graph_finance": """
        SELECT f.event_id AS ord, f.sender_id, f.receiver_id, CAST(f.date AS STRING) AS date, CAST(CAST(floor(f.amount) AS BIGINT) AS STRING) AS amount, a.bank_account AS sender_account,
               CASE WHEN f.event_id % 4 > 0 THEN b.bank_account END AS receiver_account
        FROM {finance} f LEFT JOIN {persons} a ON f.sender_id = a.person_id LEFT JOIN {persons} b ON f.receiver_id = b.person_id""",
    "graph_fir": "SELECT CASE WHEN ord % 41 > 0 THEN fir_id END AS fir_id, person_id, crime, CAST(date AS STRING) AS date, CASE WHEN ord % 17 > 0 THEN location ELSE ' ' END AS location, ord FROM {fir}",
    "graph_social": "SELECT event_id AS ord, user_id, connected_user_id, interaction_type, CAST(date AS STRING) AS date, CASE WHEN event_id % 2 = 0 THEN 'user_' || substr(user_id, 2) END AS user_handle, CAST(NULL AS STRING) AS connected_handle FROM {social}",
    "graph_surveillance": f"SELECT s.event_id, s.person_id, s.location, {_SECOND.format('s.timestamp')} AS timestamp, s.event_type, 'camera' AS source, CASE WHEN s.ord % 5 > 0 THEN p.vehicle_no END AS vehicle_no, s.ord FROM {{surveillance}} s LEFT JOIN {{persons}} p ON s.person_id = p.person_id",
    # spellings of values, so that the rules meet every form
    "phone_spellings": "SELECT c_custkey AS row_no, CASE c_custkey % 7 WHEN 0 THEN '+91 9' || lpad(CAST(c_custkey AS STRING), 9, '0') WHEN 1 THEN '9' || lpad(CAST(c_custkey AS STRING), 9, '0') WHEN 2 THEN '091-9' || lpad(CAST(c_custkey AS STRING), 9, '0') WHEN 3 THEN 'not-a-phone' WHEN 4 THEN '12' || lpad(CAST(c_custkey AS STRING), 10, '0') WHEN 5 THEN CAST(c_custkey AS STRING) ELSE '+91-9' || lpad(CAST(c_custkey AS STRING), 9, '0') || ' ext 2' END AS phone FROM {customer}",
    "place_spellings": "SELECT c_custkey AS row_no, CASE c_custkey % 9 WHEN 0 THEN ' New Delhi' WHEN 1 THEN 'BOMBAY' WHEN 2 THEN 'Ban-ga lore' WHEN 3 THEN 'pune ' WHEN 4 THEN '  ' WHEN 5 THEN 'goa' WHEN 6 THEN 'N.C.T.' WHEN 7 THEN 'None' ELSE n_name END AS place FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "date_spellings": "SELECT o_orderkey AS row_no, CASE o_orderkey % 9 WHEN 0 THEN <<date_format(o_orderdate, 'dd/MM/yyyy') ## strftime(o_orderdate, '%d/%m/%Y')>> WHEN 1 THEN <<date_format(o_orderdate, 'yyyy-MM-dd') ## strftime(o_orderdate, '%Y-%m-%d')>> WHEN 2 THEN <<date_format(o_orderdate, 'dd-MM-yyyy') ## strftime(o_orderdate, '%d-%m-%Y')>> WHEN 3 THEN <<date_format(o_orderdate, 'MM/dd/yyyy') ## strftime(o_orderdate, '%m/%d/%Y')>> WHEN 4 THEN <<date_format(o_orderdate, ' yyyy/MM/dd') ## strftime(o_orderdate, ' %Y/%m/%d')>> WHEN 5 THEN 'unknown' WHEN 6 THEN '2024-02-31' WHEN 7 THEN ' ' ELSE <<date_format(o_orderdate, 'dd.MM.yyyy') ## strftime(o_orderdate, '%d.%m.%Y')>> END AS spelt FROM {orders}",
    "time_spellings": "SELECT o_orderkey AS row_no, CASE o_orderkey % 6 WHEN 0 THEN <<date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ## strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')>> WHEN 1 THEN <<date_format(o_orderdate, 'yyyy-MM-dd') ## strftime(o_orderdate, '%Y-%m-%d')>> WHEN 2 THEN <<date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ## strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')>> WHEN 3 THEN <<date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+05:30'\") ## strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+05:30')>> WHEN 4 THEN 'nan' ELSE 'some day' END AS spelt FROM {orders}",
    "dated_notes": "SELECT 'FIR' || CAST(row_no AS STRING) AS source_ref, CASE row_no % 4 WHEN 0 THEN spelt WHEN 1 THEN '' END AS m_event_date, CASE row_no % 5 WHEN 0 THEN spelt END AS m_valid_from, CASE row_no % 3 WHEN 0 THEN spelt END AS m_event_end, CASE row_no % 7 WHEN 0 THEN spelt WHEN 1 THEN '' END AS date, 'It was DATED ' || spelt || ' and occurred on 03/04/2024.' AS text FROM {date_spellings}",
    "prose": "SELECT 'FIR' || CAST(o_orderkey AS STRING) AS source_ref, CASE o_orderkey % 6 WHEN 0 THEN 'Case No. 98' || lpad(CAST(o_custkey AS STRING), 8, '0') || ' was registered; later he called +91-98' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0') || ' from home.' WHEN 1 THEN 'Call 7' || lpad(CAST(o_custkey AS STRING), 9, '0') || ' or +91 8' || lpad(CAST(o_orderkey AS STRING), 9, '0') || '.' WHEN 2 THEN 'Paid from account 12345' || lpad(CAST(o_custkey AS STRING), 7, '0') || ' to acc' || lpad(CAST(o_orderkey AS STRING), 6, '0') || '.' WHEN 3 THEN 'Reference number 12345' || lpad(CAST(o_custkey AS STRING), 7, '0') || ' was noted.' WHEN 4 THEN 'The a/c 99' || lpad(CAST(o_orderkey AS STRING), 9, '0') || '; a long time later, after many a word, 88' || lpad(CAST(o_orderkey AS STRING), 9, '0') || '.' ELSE 'No identifier here, +91-12.' END AS text FROM {orders}",
    "model_spans": "SELECT o_orderkey AS row_no, CASE o_orderkey % 7 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE' WHEN 3 THEN 'LOC' WHEN 4 THEN 'FAC' WHEN 5 THEN 'EVENT' ELSE 'MISC' END AS label, o_orderkey % 50 AS starts, o_orderkey % 50 + o_custkey % 9 AS ends FROM {orders}",
    "reviews": "SELECT entity_type, value, jurisdiction, 'exact' AS method, CASE min(ord) % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'pending' END AS status FROM (SELECT r.entity_type, r.value, r.jurisdiction, CAST(length(r.jurisdiction) + ascii(right(r.value, 1)) AS BIGINT) AS ord FROM {resolved} r WHERE r.status = 'ambiguous') x WHERE ord % 3 > 0 GROUP BY entity_type, value, jurisdiction",
}
