"""One SQL template for each operator. Inputs stand in braces; `<<a ## b>>` is Spark's spelling and the oracle's;
`[[name: value]]` is a parameter and its value where the caller gives none."""

_BAND = "CASE WHEN {0} >= 75 THEN '{1}' WHEN {0} >= 50 THEN '{2}' WHEN {0} >= 25 THEN '{3}' ELSE '{4}' END"
RISK_BAND = _BAND.format("risk_score", "CRITICAL", "HIGH", "MEDIUM", "LOW")
ANOMALY_BAND = _BAND.format("anomaly_score", "EXTREME", "HIGH", "ELEVATED", "NORMAL")
# caps of the seven parts of the risk score, in this order: communication, financial, social, case, surveillance, bridge, influence
PARTS = {
    "communication": ("least(20, 2 * communications)", 20), "financial": ("least(20, 4 * transfers)", 20), "social": ("least(15, 3 * social)", 15), "fir": ("least(20, 10 * cases)", 20),
    "surveillance": ("least(10, 2 * surveillance)", 10), "bridge": ("least(10, round(100 * betweenness, 2))", 10), "influence": ("least(5, round(100 * pagerank, 2))", 5),
}
RISK = f"least(100, CAST(<<bround ## round_even>>({' + '.join(x for x, _ in PARTS.values())}, 0) AS BIGINT))"
_TOP = "greatest(s1, s2, s3, s4)"
# above the lowest band: every score of a half or more, else the strongest one
REASONS = f"""CASE WHEN anomaly_score < 25 THEN ''
    WHEN {_TOP} >= .5 THEN CASE WHEN s1 >= .5 THEN 'communications ' ELSE '' END || CASE WHEN s2 >= .5 THEN 'transfers ' ELSE '' END || CASE WHEN s3 >= .5 THEN 'social ' ELSE '' END || CASE WHEN s4 >= .5 THEN 'observations ' ELSE '' END
    WHEN s1 > 0 AND s1 = {_TOP} THEN 'communications ' WHEN s2 > 0 AND s2 = {_TOP} THEN 'transfers ' WHEN s3 > 0 AND s3 = {_TOP} THEN 'social ' WHEN s4 > 0 THEN 'observations ' ELSE '' END"""
LIMITS = "'Recurrence of an identifier is not proof of common ownership.'"

OPERATORS = {
    # scans, sources, sinks
    "a1_persons": "SELECT person_id, name, phone, vehicle_no, bank_account, social_id, home_city, risk_group FROM {persons}",
    "a2_base_overlay": "SELECT person_id, name, home_city, CAST(NULL AS STRING) AS _import_id FROM {persons} UNION ALL SELECT 'IMP-' || person_id, name, NULL, 'batch' || CAST(ord % 3 AS STRING) FROM {persons} WHERE ord % 97 = 0",
    "a3_vehicles": "SELECT * FROM {vehicles}",
    "a3_cdr": "SELECT * FROM {cdr}",
    "a3_finance": "SELECT * FROM {finance}",
    "a3_fir": "SELECT fir_id, person_id, crime, date, location FROM {fir}",
    "a3_social": "SELECT * FROM {social}",
    "a3_surveillance": "SELECT event_id, person_id, location, timestamp, event_type FROM {surveillance}",
    "a3_entity_mapping": "SELECT entity_id, entity_type, source_id, source FROM {entity_mapping}",
    "a4_record_projection": "SELECT person_id, name, phone FROM (SELECT *, 'x' AS _import_id FROM {persons}) p",
    "a6_overlay_delete": "SELECT 'persons' AS source, count(*) AS removed FROM {persons} WHERE ord % 97 = 0 AND 'batch' || CAST(ord % 3 AS STRING) = 'batch1' UNION ALL SELECT 'fir', count(*) FROM {fir} WHERE ord % 97 = 0 AND ord % 3 = 1",
    "a9_cell_cleanup": "SELECT row_no, fir_id, name, date FROM {clean_uploads}",
    "a10_column_samples": "SELECT field, value, n FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY row_no) AS n FROM (SELECT row_no, 'fir_id' AS field, fir_id AS value FROM {clean_uploads} UNION ALL SELECT row_no, 'name', name FROM {clean_uploads} UNION ALL SELECT row_no, 'phone', phone FROM {clean_uploads}) f WHERE value IS NOT NULL) s WHERE n <= 3",
    "a12_narrative_input": "SELECT source_ref, coalesce(CASE WHEN trim(jurisdiction) <> '' THEN jurisdiction END, 'UNSPECIFIED') AS jurisdiction, text FROM {narratives} WHERE trim(source_ref) <> '' AND trim(text) <> ''",
    "a13_narrative_record": "SELECT 'unstructured_fir:' || source_ref AS record_id, <<sha2(text, 256) ## sha256(text)>> AS content_hash, text FROM {narratives}",
    "a14_graph_sink": "SELECT relationship, source, target, min(edge_id) AS first_edge, count(*) AS merged FROM {edges} GROUP BY relationship, source, target",
    "a15_dry_run_summary": "SELECT 'node' AS kind, coalesce(entity_type, 'untyped') AS label, count(*) AS n FROM {nodes} GROUP BY entity_type UNION ALL SELECT 'relationship', relationship, count(*) FROM {edges} GROUP BY relationship",
    "a16_contract_export": "SELECT 'Phone' AS label, phone AS key_value, count(DISTINCT person_id) AS owners, min(person_id) AS first_source_ref FROM {persons} GROUP BY phone UNION ALL SELECT 'Account', bank_account, count(DISTINCT person_id), min(person_id) FROM {persons} GROUP BY bank_account",
    # normalisation
    "b1_clean_text": "SELECT row_no, fir_id, name FROM {clean_uploads}",
    "b2_stable_record_id": "SELECT row_no, CASE WHEN fir_id IS NOT NULL AND name IS NOT NULL THEN 'upload:' || fir_id || ':' || name ELSE 'upload:row:' || CAST(row_no AS STRING) END AS record_id FROM {clean_uploads}",
    "b3_content_hash": """
        SELECT person_id, <<sha2(to_json(named_struct('data', named_struct('bank_account', bank_account, 'home_city', home_city, 'name', name, 'person_id', person_id, 'phone', phone, 'risk_group', risk_group, 'social_id', social_id, 'vehicle_no', vehicle_no), 'source', 'persons'), map('ignoreNullFields', 'false')), 256)
                        ## sha256(CAST(to_json({{'data': {{'bank_account': bank_account, 'home_city': home_city, 'name': name, 'person_id': person_id, 'phone': phone, 'risk_group': risk_group, 'social_id': social_id, 'vehicle_no': vehicle_no}}, 'source': 'persons'}}) AS VARCHAR))>> AS content_hash
        FROM {persons}""",
    "b4_duplicate_hashes": "SELECT h AS content_hash, count(*) AS n, min(person_id) AS first_record_id FROM (SELECT person_id, <<sha2(phone, 256) ## sha256(phone)>> AS h FROM {persons}) p GROUP BY h HAVING count(*) > 1",
    "b5_phone": "SELECT person_id, CASE WHEN length(d) >= 12 AND substr(d, 1, 2) = '91' THEN '+91' || right(d, 10) WHEN length(d) = 10 THEN '+91' || d ELSE phone END AS phone FROM (SELECT person_id, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM {persons}) p",
    "b6_upper_identifiers": "SELECT person_id, upper(regexp_replace(lower(vehicle_no), '[ ]+', '', 'g')) AS vehicle_no, upper(regexp_replace(bank_account, '[ ]+', '', 'g')) AS bank_account FROM {persons}",
    "b9_crime_canonical": "SELECT match_key, min_by(crime, ord) AS spelling, count(*) AS n FROM (SELECT crime, ord, regexp_replace(lower(crime), '[^a-z0-9]', '', 'g') AS match_key FROM {cases}) c GROUP BY match_key",
    "b14_bands": f"SELECT person_id, anomaly_score, {ANOMALY_BAND} AS band FROM {{anomaly}}",
    "b15_review_fingerprint": "SELECT entity_type, value, <<sha2(entity_type || '|' || lower(trim(value)) || '|exact|' || upper(jurisdiction), 256) ## sha256(entity_type || '|' || lower(trim(value)) || '|exact|' || upper(jurisdiction))>> AS fingerprint FROM {resolved} WHERE status = 'ambiguous' GROUP BY entity_type, value, jurisdiction",
    "b16_identity_hash": """
        SELECT row_no, <<sha2(told, 256) ## sha256(told)>> AS identity
        FROM (SELECT row_no, 'crime=|date=' || coalesce(CAST(date_parsed AS STRING), '') || '|fir_id=' || coalesce(fir_id, '') || '|location=|name=' || coalesce(name, '') || '|person_id=|phone=' || coalesce(phone_norm, '') || '|vehicle_no=' AS told FROM {clean_uploads}) u""",
    "b18_entity_labels": "SELECT id, coalesce(entity_type, 'unknown') || ': ' || id AS label FROM {nodes}",
    # extraction
    "c2_vehicle_mentions": "SELECT source_ref, value FROM {mentions} WHERE entity_type = 'vehicle'",
    "c4_ifsc_mentions": "SELECT source_ref, value FROM {mentions} WHERE entity_type = 'ifsc'",
    "c5_record_mentions": "SELECT entity_type, count(*) AS mentions, count(DISTINCT value) AS different FROM {mentions} GROUP BY entity_type",
    # resolution
    "d1_registry": "SELECT entity_type, value, entity_id FROM {registry}",
    "d2_confirmed": "SELECT entity_type, source_id, max_by(entity_id, ord) AS entity_id FROM {entity_mapping} GROUP BY entity_type, source_id",
    "d3_exact_match": "SELECT source_ref, entity_type, value, status, entity_id, confidence FROM {resolved}",
    "d6_rejection_guard": "SELECT r.source_ref, r.entity_type, r.value, CASE WHEN j.value IS NOT NULL AND r.status <> 'unresolved' THEN 'unresolved' ELSE r.status END AS status, CASE WHEN j.value IS NOT NULL AND r.status <> 'unresolved' THEN 'rejected by a reviewer' END AS note FROM {resolved} r LEFT JOIN (SELECT DISTINCT entity_type, value, jurisdiction FROM {reviews} WHERE status = 'rejected' AND method = 'exact') j ON r.entity_type = j.entity_type AND lower(trim(r.value)) = lower(trim(j.value)) AND upper(r.jurisdiction) = upper(j.jurisdiction)",
    "d8_status_summary": "SELECT entity_type, status, count(*) AS n FROM {resolved} GROUP BY entity_type, status",
    "d9_review_queue": "SELECT r.entity_type, r.value, r.jurisdiction, max(r.owners) AS proposed, count(*) AS mentions FROM {resolved} r LEFT JOIN (SELECT DISTINCT entity_type, value, jurisdiction FROM {reviews} WHERE status <> 'pending' AND method = 'exact') j ON r.entity_type = j.entity_type AND r.value = j.value AND r.jurisdiction = j.jurisdiction WHERE r.status = 'ambiguous' AND j.value IS NULL GROUP BY r.entity_type, r.value, r.jurisdiction",
    "d10_pending": """
        SELECT entity_type, value, min(event_date) AS created_at FROM {resolved} WHERE status = 'ambiguous' GROUP BY entity_type, value ORDER BY created_at, entity_type, value""",
    "d12_shared_identifiers": "SELECT kind, value, l, r, 0.95 AS confidence FROM (SELECT 'phone' AS kind, a.phone AS value, a.person_id AS l, b.person_id AS r FROM {persons} a JOIN {persons} b ON a.phone = b.phone AND a.ord < b.ord UNION ALL SELECT 'vehicle', a.vehicle_no, a.person_id, b.person_id FROM {persons} a JOIN {persons} b ON a.vehicle_no = b.vehicle_no AND a.ord < b.ord UNION ALL SELECT 'bank_account', a.bank_account, a.person_id, b.person_id FROM {persons} a JOIN {persons} b ON a.bank_account = b.bank_account AND a.ord < b.ord) s",
    "d14_mention_validation": "SELECT row_no, CASE WHEN fir_id IS NULL THEN 'fir_id ' ELSE '' END || CASE WHEN name IS NULL THEN 'name ' ELSE '' END AS missing FROM {clean_uploads} WHERE fir_id IS NULL OR name IS NULL",
    # graph construction
    "e1_nodes": "SELECT id, entity_type FROM {nodes}",
    "e2_edges": "SELECT edge_id, source, target, relationship FROM {edges}",
    "e3_network_statistics": "SELECT count(*) AS nodes, count_if(entity_type = 'person') AS persons, count_if(entity_type = 'vehicle') AS vehicles, count_if(entity_type = 'crime_event') AS cases, count_if(entity_type = 'surveillance_event') AS observations, (SELECT count(*) FROM {edges}) AS edges FROM {nodes}",
    "e4_graph_export": "SELECT source, target, relationship, CASE WHEN amount IS NULL THEN duration ELSE amount END AS weight FROM {edges} WHERE source IS NOT NULL AND target IS NOT NULL",
    "e5_property_nodes": "SELECT 'Person' AS label, 'person_id' AS key_property, person_id AS key_value FROM {persons} UNION ALL SELECT DISTINCT 'Phone', 'phone', phone FROM {persons} UNION ALL SELECT DISTINCT 'Vehicle', 'vehicle_no', vehicle_no FROM {persons} UNION ALL SELECT DISTINCT 'Account', 'bank_account', bank_account FROM {persons} UNION ALL SELECT 'FIR', 'fir_id', fir_id FROM {fir}",
    "e6_canonical_calls": "SELECT a.phone AS from_phone, b.phone AS to_phone, count(*) AS calls FROM {cdr} c JOIN {persons} a ON c.caller_id = a.person_id JOIN {persons} b ON c.receiver_id = b.person_id GROUP BY a.phone, b.phone",
    "e7_provenance": "SELECT edge_id, relationship || ':' || CAST(edge_id AS STRING) AS source_ref, 'structured' AS extraction_method, 1.0 AS confidence FROM {edges}",
    "e8_provenance_check": "SELECT edge_id FROM (SELECT edge_id, CASE WHEN edge_id % 101 = 0 THEN '' ELSE relationship END AS source_ref FROM {edges}) e WHERE source_ref = ''",
    "e9_uniqueness_check": "SELECT 'Phone' AS label, phone AS key_value, count(*) AS n FROM {persons} GROUP BY phone HAVING count(*) > 1",
    "e11_person_projection": "SELECT source AS a, target AS b, relationship FROM {person_edges} UNION ALL SELECT target, source, relationship FROM {person_edges}",
    "e12_temporal_filter": "SELECT edge_id FROM {edges} WHERE seen_at IS NULL OR (seen_at >= CAST([[begin: '2024-01-05 00:00:00']] AS TIMESTAMP) AND seen_at <= CAST([[end: '2024-01-20 00:00:00']] AS TIMESTAMP))",
    # graph analytics
    "f1_degree_centrality": "SELECT n.id, round(coalesce(d, 0) / ((SELECT count(*) FROM {nodes}) - 1), 4) AS degree FROM {nodes} n LEFT JOIN (SELECT id, count(*) AS d FROM {ends} GROUP BY id) e ON n.id = e.id",
    "f12_two_hops": "SELECT DISTINCT id FROM (SELECT [[seed: 'P1']] AS id UNION ALL SELECT other FROM {ends} WHERE id = [[seed: 'P1']] UNION ALL SELECT b.other FROM {ends} a JOIN {ends} b ON a.other = b.id WHERE a.id = [[seed: 'P1']]) h",
    "f18_satellites": "SELECT other AS id, min(id) AS owner FROM {ends} WHERE id LIKE 'P%' AND other NOT LIKE 'P%' GROUP BY other",
    "f19_distinct_neighbours": "SELECT id, count(DISTINCT other) AS neighbours FROM {ends} WHERE id <> other GROUP BY id",
    "f20_strongest_partner": "SELECT id, other AS partner, n FROM (SELECT id, other, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS k FROM (SELECT id, other, count(*) AS n FROM {ends} WHERE id LIKE 'P%' AND other LIKE 'P%' AND id <> other GROUP BY id, other) c) r WHERE k = 1",
    "f16_overview": "SELECT id, count(*) AS d FROM {ends} WHERE id LIKE 'P%' GROUP BY id ORDER BY d DESC, id LIMIT 28",
    # scores and findings
    "g1_risk_activity": "SELECT * FROM {activity}",
    "g2_risk_score": f"SELECT person_id, risk_score, {RISK_BAND} AS band FROM (SELECT person_id, {RISK} AS risk_score FROM {{risk_inputs}}) r",
    "g4_risk_signals": f"SELECT person_id, {', '.join(f'round({x} / {cap}, 2) AS {name}' for name, (x, cap) in PARTS.items())}, {RISK} AS risk_score, 'rule_based' AS scoring_method FROM {{risk_inputs}}",
    "g5_anomaly_activity": "SELECT person_id, communications, transfers, social, observations FROM {activity}",
    "g6_robust_scores": "SELECT person_id, s1, s2, s3, s4 FROM {anomaly}",
    "g7_anomaly_profile": f"SELECT person_id, anomaly_score, {ANOMALY_BAND} AS band, {REASONS} AS reasons, 'Activity outlier; not a criminality classifier.' AS limits FROM {{anomaly}}",
    "g8_anomaly_distribution": f"""
        SELECT b.kind, b.band, coalesce(n, 0) AS n, CASE WHEN total > 0 THEN round(CAST(100 AS DOUBLE) * coalesce(n, 0) / total, 4) ELSE CAST(0 AS DOUBLE) END AS percent
        FROM (SELECT 'anomaly' AS kind, 'EXTREME' AS band UNION ALL SELECT 'anomaly', 'HIGH' UNION ALL SELECT 'anomaly', 'ELEVATED' UNION ALL SELECT 'anomaly', 'NORMAL'
              UNION ALL SELECT 'risk', 'CRITICAL' UNION ALL SELECT 'risk', 'HIGH' UNION ALL SELECT 'risk', 'MEDIUM' UNION ALL SELECT 'risk', 'LOW') b
        LEFT JOIN (SELECT 'anomaly' AS kind, {ANOMALY_BAND} AS band, count(*) AS n FROM {{anomaly}} GROUP BY 2
                   UNION ALL SELECT 'risk', {RISK_BAND}, count(*) FROM (SELECT {RISK} AS risk_score FROM {{risk_inputs}}) r GROUP BY 2) a ON a.kind = b.kind AND a.band = b.band
        LEFT JOIN (SELECT 'anomaly' AS kind, count(*) AS total FROM {{anomaly}} UNION ALL SELECT 'risk', count(*) FROM {{risk_inputs}}) t ON t.kind = b.kind""",
    "g9_composition": "SELECT coalesce(entity_type, 'untyped') AS entity_type, round(count(*) / (SELECT count(*) FROM {nodes}), 6) AS share FROM {nodes} GROUP BY entity_type",
    "g10_recurrence": "SELECT entity_type, value, count(DISTINCT source_ref) AS cases, count(DISTINCT jurisdiction) AS jurisdictions FROM {mentions} GROUP BY entity_type, value HAVING count(DISTINCT source_ref) >= 3 AND count(DISTINCT jurisdiction) >= 2",
    "g11_recurrence_evidence": "SELECT r.entity_type, r.value, r.source_ref, r.jurisdiction, r.confidence FROM {resolved} r JOIN (SELECT entity_type, value FROM {mentions} GROUP BY entity_type, value HAVING count(DISTINCT source_ref) >= 3 AND count(DISTINCT jurisdiction) >= 2) f ON r.entity_type = f.entity_type AND r.value = f.value",
    "g12_findings": f"SELECT entity_type, value, count(DISTINCT source_ref) AS cases, min(confidence) AS confidence, min(event_date) AS valid_from, max(event_date) AS valid_to, {LIMITS} AS limits FROM {{resolved}} GROUP BY entity_type, value HAVING count(DISTINCT source_ref) >= 3 AND count(DISTINCT jurisdiction) >= 2",
    "g13_top_anomalies": "SELECT person_id, anomaly_score FROM {anomaly} ORDER BY anomaly_score DESC, person_id LIMIT 15",
    "g15_signal_ranking": f"SELECT person_id, signal, points, row_number() OVER (PARTITION BY person_id ORDER BY points DESC, signal) AS k FROM ({' UNION ALL '.join(f"SELECT person_id, '{name}' AS signal, CAST({x} AS DOUBLE) AS points FROM {{risk_inputs}}" for name, (x, _) in PARTS.items())}) s WHERE points > 0",
    # imports
    "h4_row_split": "SELECT row_no, fir_id, name, phone_norm AS phone, jurisdiction, date AS unmapped_date FROM {clean_uploads}",
    "h5_row_validation": "SELECT row_no, status FROM {assessed}",
    "h6_in_file_duplicates": "SELECT row_no, n FROM (SELECT row_no, row_number() OVER (PARTITION BY coalesce(fir_id, ''), coalesce(name, ''), coalesce(phone_norm, '') ORDER BY row_no) AS n FROM {clean_uploads}) d WHERE n > 1",
    "h7_existing_keys": "SELECT u.row_no, u.fir_id FROM {clean_uploads} u JOIN (SELECT DISTINCT fir_id FROM {cases}) k ON u.fir_id = k.fir_id",
    "h9_disposition": "SELECT row_no, CASE status WHEN 'ready' THEN 'import' WHEN 'incomplete' THEN 'import' WHEN 'duplicate' THEN 'skipped' ELSE 'failed' END AS disposition, status IN ('ready', 'incomplete') AS importable FROM {assessed}",
    "h10_redaction": "SELECT row_no, status, CASE WHEN seen THEN name END AS name, CASE WHEN seen THEN phone END AS phone, NOT seen AS redacted, CASE WHEN NOT seen THEN 'outside your jurisdictions' END AS reason FROM (SELECT *, [[admin: false]] OR array_contains([[jurisdictions: <<array('NATION_1', 'NATION_2') ## ['NATION_1', 'NATION_2']>>]], jurisdiction) AS seen FROM {assessed}) a",
    "h11_validation_summary": "SELECT status, count(*) AS n FROM {assessed} GROUP BY status",
    "h12_person_key": "SELECT row_no, 'IMP-' || lpad(CAST(min(row_no) OVER (PARTITION BY coalesce(name, ''), coalesce(phone, '')) AS STRING), 8, '0') AS person_id FROM {assessed}",
    "h13_fan_out": "SELECT 'persons' AS target, coalesce(name, '') AS id, count(*) AS n FROM {assessed} WHERE status = 'ready' GROUP BY name UNION ALL SELECT 'fir', fir_id, count(*) FROM {assessed} WHERE status = 'ready' AND fir_id IS NOT NULL GROUP BY fir_id",
    "h14_outcome": "SELECT CASE WHEN count_if(status = 'ready') = 0 THEN 'failed' WHEN count_if(status = 'invalid') > 0 THEN 'partial' WHEN count_if(status = 'incomplete') > 0 THEN 'complete_with_warnings' ELSE 'complete' END AS outcome, count(*) AS n FROM {assessed}",
    # lookups, rollups, reports
    "i1_locations": """
        SELECT 'location' AS kind, home_city AS id FROM {persons} GROUP BY home_city
        UNION ALL SELECT 'person', person_id FROM {persons}
        UNION ALL SELECT 'vehicle', vehicle_no FROM {vehicles}
        UNION ALL SELECT 'phone', source_id FROM {entity_mapping} WHERE entity_type = 'phone'""",
    "i2_case_list": """
        SELECT c.fir_id, c.crime, c.location, c.date, c.person_id, p.name
        FROM {cases} c LEFT JOIN {persons} p ON c.person_id = p.person_id
        WHERE ([[crime: 'cyber crime']] = '' OR lower(trim(c.crime)) = lower(trim([[crime: 'cyber crime']])))
          AND ([[location: '']] = '' OR lower(trim(c.location)) = lower(trim([[location: '']])))
          AND ([[person: '']] = '' OR lower(trim(c.person_id)) = lower(trim([[person: '']])))
        ORDER BY c.date DESC NULLS LAST, c.fir_id DESC""",
    "i3_case_detail": "SELECT c.fir_id, c.crime, p.name FROM {cases} c JOIN {persons} p ON c.person_id = p.person_id WHERE c.fir_id = [[case_id: 'FIR1']]",
    "i4_case_search": """
        SELECT c.fir_id FROM {cases} c LEFT JOIN {persons} p ON c.person_id = p.person_id
        WHERE contains(lower(concat_ws(' ', c.fir_id, c.crime, c.location, CAST(c.date AS STRING), c.person_id, p.name)), lower([[words: 'cyber']]))
          AND ([[crime: '']] = '' OR c.crime = [[crime: '']]) AND ([[location: '']] = '' OR c.location = [[location: '']])""",
    "i5_case_summary": "SELECT count(*) AS total, count(DISTINCT crime) AS crimes, count(DISTINCT location) AS locations, count(DISTINCT person_id) AS people FROM {cases}",
    "i6_case_risk": f"SELECT c.fir_id, coalesce(r.risk_score, 0) AS risk_score FROM {{fir}} c LEFT JOIN (SELECT person_id, {RISK} AS risk_score FROM {{risk_inputs}}) r ON c.person_id = r.person_id",
    "i7_roster": f"SELECT p.person_id, p.name, coalesce(r.risk_score, 0) AS risk_score, lower(concat_ws(' ', p.person_id, p.name, p.home_city)) AS haystack FROM {{persons}} p LEFT JOIN (SELECT person_id, {RISK} AS risk_score FROM {{risk_inputs}}) r ON p.person_id = r.person_id",
    "i8_roster_search": """
        SELECT person_id, name, home_city, risk_group FROM {persons}
        WHERE contains(lower(concat_ws(' ', person_id, name, home_city)), lower([[words: 'kumar']]))
        ORDER BY CASE [[sort: 'name']] WHEN 'name' THEN name WHEN 'city' THEN home_city WHEN 'group' THEN risk_group WHEN 'phone' THEN phone WHEN 'vehicle' THEN vehicle_no END NULLS LAST, person_id""",
    "i9_parallel_edges": "SELECT source, relationship, target, count(*) AS n FROM {edges} GROUP BY source, relationship, target",
    "i10_relationship_counts": """
        SELECT 'relationship' AS kind, relationship AS name, count(*) AS n FROM {edges} GROUP BY relationship
        UNION ALL SELECT 'node', coalesce(entity_type, 'untyped'), count(*) FROM {nodes} GROUP BY entity_type""",
    "i11_edge_rollup": "SELECT source, target, round(sum(amount), 2) AS amount, sum(duration) AS duration, min(seen_at) AS earliest, max(seen_at) AS latest FROM {edges} GROUP BY source, target",
    "i12_node_relationships": "SELECT id, relationship, count(DISTINCT other) AS links, count(*) AS interactions FROM {ends} GROUP BY id, relationship",
    "i13_associations": "SELECT id, other, relationship, row_number() OVER (PARTITION BY id, relationship ORDER BY n DESC, other) AS k FROM (SELECT id, other, relationship, count(*) AS n FROM {ends} WHERE id <> other AND id LIKE 'P%' GROUP BY id, other, relationship) a",
    "i14_connected_people": """
        SELECT id, other, count(*) AS interactions, <<array_join(array_sort(collect_set(relationship)), ',') ## string_agg(DISTINCT relationship, ',' ORDER BY relationship)>> AS relationships
        FROM {ends} WHERE id LIKE 'P%' AND other LIKE 'P%' AND id <> other GROUP BY id, other""",
    "i15_connection_counts": "SELECT id, relationship, count(*) AS interactions, count(DISTINCT other) AS counterparts FROM {ends} WHERE id LIKE 'P%' GROUP BY id, relationship",
    "i16_timeline": "SELECT id, edge_id, relationship, seen_at, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, edge_id) AS k FROM {ends} WHERE seen_at IS NOT NULL AND id LIKE 'P%'",
    "i17_strongest_neighbours": "SELECT id, other, n FROM (SELECT id, other, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS k FROM (SELECT id, other, count(*) AS n FROM {ends} WHERE id LIKE 'P%' GROUP BY id, other) c) r WHERE k <= 12",
    "i18_entity_search": "SELECT id, CASE WHEN left(lower(id), length([[words: 'p1']])) = lower([[words: 'p1']]) THEN 0 ELSE 1 END AS hit FROM {nodes} WHERE contains(lower(id), lower([[words: 'p1']])) ORDER BY 2, 1 LIMIT 30",
    "i19_type_filter": """
        SELECT e.edge_id FROM {edges} e JOIN {nodes} a ON e.source = a.id JOIN {nodes} b ON e.target = b.id
        WHERE array_contains([[types: <<array('person') ## ['person']>>]], a.entity_type) AND array_contains([[types: <<array('person') ## ['person']>>]], b.entity_type)
          AND array_contains([[relationships: <<array('CALLED', 'SOCIAL_REPLY') ## ['CALLED', 'SOCIAL_REPLY']>>]], e.relationship)""",
    "i20_jurisdiction_filter": "SELECT event_id FROM {audit} WHERE [[admin: false]] OR array_contains([[jurisdictions: <<array('J1', 'J2') ## ['J1', 'J2']>>]], jurisdiction)",
    "i21_audit_page": "SELECT event_id, user_id, action, result FROM (SELECT * FROM {audit} ORDER BY ts DESC, event_id DESC LIMIT 500) a WHERE [[admin: false]] OR jurisdiction IS NULL OR array_contains([[jurisdictions: <<array('J1', 'J2') ## ['J1', 'J2']>>]], jurisdiction)",
    "i22_report_scope": "SELECT DISTINCT c.fir_id, c.person_id FROM {fir} c JOIN (SELECT person_id FROM {persons} WHERE ord % 10 = 1) s ON c.person_id = s.person_id",
    "i23_report_network": "SELECT edge_id, source, target FROM {edges} WHERE source = [[person_id: 'P1']] OR target = [[person_id: 'P1']] ORDER BY edge_id LIMIT 80",
    "i25_relevant_reviews": "SELECT DISTINCT r.entity_type, r.value FROM {resolved} r JOIN {registry} g ON r.entity_type = g.entity_type AND r.value = g.value WHERE r.status = 'ambiguous'",
    "i26_evidence": "SELECT 'case' AS kind, fir_id AS ref FROM {fir} UNION ALL SELECT 'mapping', entity_id || ':' || source_id FROM {entity_mapping}",
    "i29_entry_options": "SELECT 'crime' AS kind, crime AS option FROM {cases} GROUP BY crime UNION ALL SELECT 'jurisdiction', location FROM {cases} GROUP BY location",
    # entity extractor, span fusion, fuzzy names, decisions
    "c6_rule_entities": "SELECT source_ref, kind, value, starts, ends FROM {ner_spans}",
    "d4_name_scores": "SELECT mention, name, score FROM {name_scores}",
    "d5_name_decision": "SELECT m.mention, CASE WHEN r.score IS NULL OR r.score < 92 THEN 'unresolved' WHEN r.score - r.next_score < 3 THEN 'ambiguous' ELSE 'resolved' END AS status, r.score, CASE WHEN r.score >= 92 THEN r.name END AS name FROM {name_mentions} m LEFT JOIN (SELECT * FROM {name_ranked} WHERE k = 1) r ON m.mention = r.mention",
    "d7_cascade": "SELECT r.source_ref, r.entity_type, r.value, CASE WHEN r.value = '' THEN 'unresolved' WHEN c.entity_id IS NOT NULL THEN 'exact' WHEN r.entity_type IN ('location', 'organisation', 'event') THEN 'unresolved' ELSE r.status END AS status, coalesce(c.entity_id, r.entity_id) AS entity_id FROM {resolved} r LEFT JOIN {confirmed} c ON r.entity_type = c.entity_type AND r.value = c.value",
    "d11_apply_decisions": "SELECT d.entity_type, d.value, d.entity_id, CASE WHEN q.value IS NULL THEN 'not pending' WHEN g.entity_id IS NULL THEN 'not proposed' ELSE 'accepted' END AS outcome FROM {confirmed} d LEFT JOIN (SELECT DISTINCT entity_type, value FROM {resolved} WHERE status = 'ambiguous') q ON d.entity_type = q.entity_type AND d.value = q.value LEFT JOIN {registry} g ON d.entity_type = g.entity_type AND d.value = g.value AND d.entity_id = g.entity_id",
    "d13_candidate_list": "SELECT mention, name, score, k FROM {name_ranked} WHERE k <= 3",
    "e10_narrative_graph": "SELECT DISTINCT source, relationship, target FROM (SELECT entity_id AS source, CASE entity_type WHEN 'phone' THEN 'HAS_PHONE' WHEN 'vehicle' THEN 'OWNS' ELSE 'HAS_ACCOUNT' END AS relationship, value AS target FROM {resolved} WHERE status = 'resolved' UNION ALL SELECT entity_id, 'INVOLVED_IN', source_ref FROM {resolved} WHERE status = 'resolved' UNION ALL SELECT source_ref, 'USES', value FROM {resolved} WHERE status = 'resolved' UNION ALL SELECT entity_id, 'CO_ACCUSED_IN', source_ref FROM {resolved} WHERE status = 'resolved') e",
    "f13_relationship_whitelist": """
        SELECT e.edge_id, e.relationship FROM {edges} e
        LEFT JOIN (SELECT count(*) AS known FROM (SELECT DISTINCT relationship FROM {edges}) r WHERE array_contains([[types: <<array('CALLED', 'NO_SUCH_TYPE') ## ['CALLED', 'NO_SUCH_TYPE']>>]], relationship)) k ON true
        WHERE k.known = 0 OR array_contains([[types: <<array('CALLED', 'NO_SUCH_TYPE') ## ['CALLED', 'NO_SUCH_TYPE']>>]], e.relationship)""",
    "f21_path_edges": "SELECT p.sender_id AS source, p.receiver_id AS target, x.edge_id AS exact_edge, coalesce(x.edge_id, y.edge_id) AS edge_id FROM (SELECT DISTINCT sender_id, receiver_id FROM {finance}) p LEFT JOIN (SELECT source, target, min(edge_id) AS edge_id FROM {edges} WHERE relationship = 'CALLED' GROUP BY source, target) x ON x.source = p.sender_id AND x.target = p.receiver_id LEFT JOIN (SELECT id, other, min(edge_id) AS edge_id FROM {ends} GROUP BY id, other) y ON y.id = p.sender_id AND y.other = p.receiver_id",
    "h8_possible_duplicates": "SELECT u.row_no, min(p.person_id) AS person_id, count(*) AS owners FROM {clean_uploads} u JOIN (SELECT person_id, '+91' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone FROM {persons}) p ON u.phone_norm = p.phone GROUP BY u.row_no UNION ALL SELECT u.row_no, min('P' || CAST(c.c_custkey AS STRING)), count(*) FROM {clean_uploads} u JOIN {customer} c ON lower(u.name) = lower(c.c_name) GROUP BY u.row_no",
    "h15_import_history": "SELECT event_id, user_id, ts FROM {audit} WHERE action = 'purchase' AND ([[admin: false]] OR user_id = [[user_id: 'user7']]) ORDER BY ts DESC, event_id DESC",
    "i24_report_analytics": f"SELECT section, person_id, score, k FROM (SELECT section, person_id, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, person_id) AS k FROM (SELECT 'risk' AS section, person_id, {RISK} AS score FROM {{risk_inputs}} UNION ALL SELECT 'anomaly', person_id, anomaly_score FROM {{anomaly}}) a) r WHERE k <= 50",
    "i28_investigations": "SELECT fir_id, date, location FROM {cases} WHERE [[admin: false]] OR array_contains([[jurisdictions: <<array('NATION_1', 'NATION_2', 'NATION_3') ## ['NATION_1', 'NATION_2', 'NATION_3']>>]], location) ORDER BY date DESC, fir_id",
    # redaction, header matching, report rows
    "b17_metadata_redaction": "SELECT event_id, <<to_json(map_filter(map('user', user_id, 'result', result, CASE event_id % 3 WHEN 0 THEN ' Token ' WHEN 1 THEN 'PASSWORD' ELSE 'note' END, action), (k, v) -> lower(trim(k)) NOT IN ('password', 'password_hash', 'access_token', 'token', 'jwt', 'secret', 'authorization', 'credentials', 'bearer'))) ## '{{\"user\":\"' || user_id || '\",\"result\":\"' || result || '\"' || CASE WHEN event_id % 3 = 2 THEN ',\"note\":\"' || action || '\"' ELSE '' END || '}}'>> AS metadata FROM {audit}",
    "h1_header_alias": "SELECT file_id, pos, header, field, field IS NOT NULL AS mapped FROM {header_fields}",
    "h3_mapping_override": """
        SELECT file_id, pos, header, CASE WHEN choice IS NULL AND taken = 1 THEN NULL ELSE target END AS field, CASE WHEN choice IS NULL THEN 'alias' ELSE 'user' END AS method
        FROM (SELECT file_id, pos, header, choice, target, max(CASE WHEN choice IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, coalesce(target, header) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken
              FROM (SELECT f.file_id, f.pos, f.header, c.choice, CASE WHEN c.choice IS NULL THEN f.field WHEN c.choice IN (SELECT field FROM {aliases}) THEN c.choice END AS target
                    FROM {header_fields} f LEFT JOIN {header_choices} c ON f.file_id = c.file_id AND f.pos = c.pos) t) w""",
    "i27_report_row": f"""
        SELECT r.person_id, r.cases, r.case_refs, coalesce(a.score, 0) AS risk_score, {LIMITS} AS limits
        FROM (SELECT person_id, count(*) AS cases, <<array_join(transform(array_sort(collect_list(CASE WHEN k <= 80 THEN struct(k, fir_id) END)), x -> x.fir_id), ',') ## string_agg(fir_id, ',' ORDER BY k) FILTER (WHERE k <= 80)>> AS case_refs
              FROM (SELECT person_id, fir_id, row_number() OVER (PARTITION BY person_id ORDER BY date DESC, fir_id) AS k FROM {{cases}}) c GROUP BY person_id) r
        LEFT JOIN (SELECT person_id, {RISK} AS score FROM {{risk_inputs}}) a ON r.person_id = a.person_id""",
}
