"""SQL counterparts of the driver's queries, over the same whole tables."""

from __future__ import annotations

BASE = {
    "people": """
        SELECT c_custkey AS id, CAST(n_regionkey AS BIGINT) AS tenant_id, c_name AS display_name,
               lower(c_name) || '@nation' || c_nationkey || '.example' AS primary_email,
               c_mktsegment AS company, n_name AS title,
               CASE WHEN c_acctbal < 0 AND c_custkey > 0 THEN c_custkey // 2 END AS merged_into_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "live": "SELECT * FROM people WHERE merged_into_id IS NULL",
    "interactions": """
        SELECT p.tenant_id, e.user_id AS person_id,
               CASE event_type WHEN 'click' THEN 'gmail' WHEN 'view' THEN 'calendar'
                    WHEN 'purchase' THEN 'contacts' ELSE 'linkedin' END AS source_type,
               e.event_id || '#' || e.user_id AS source_record_id,
               CAST(e.event_id AS VARCHAR) AS external_id, event_type AS interaction_type, ts AS occurred_at,
               'k=' || (props::JSON->>'k') AS subject,
               CASE WHEN event_type = 'error' THEN ts END AS deleted_at
        FROM events e JOIN people p ON e.user_id = p.id""",
    "sources": """
        SELECT i.tenant_id, i.person_id, i.source_type, i.source_record_id, NULL::DOUBLE AS matched_confidence
        FROM interactions i
        UNION ALL
        SELECT p.tenant_id, o_custkey, 'contacts', 'o' || o_orderkey, round(o_totalprice / 1e6, 4)
        FROM orders JOIN people p ON o_custkey = p.id""",
    "chunks": """
        SELECT p.tenant_id, p.id AS person_id, doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS source_record_id,
               CAST(doc_id AS VARCHAR) AS external_id,
               CASE WHEN lang = 'en' THEN 'gmail' ELSE 'contacts' END AS source_type,
               sha256(text) AS content_hash, text AS chunk_text
        FROM documents JOIN people p ON doc_id % (SELECT count(*) FROM customer) = p.id""",
    "vectors": """
        SELECT p.tenant_id, p.id AS person_id, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding,
               CAST(label AS BIGINT) AS label
        FROM embeddings JOIN people p ON vec_id % (SELECT count(*) FROM customer) = p.id""",
    "questions": """
        SELECT conv_id || '-' || turn || suffix AS qid, p.tenant_id, p.id AS asker, w AS wording,
               CASE w WHEN 0 THEN 'Who do I know at ' || lower(p.company) || '?'
                    WHEN 1 THEN 'When did I last talk to ' || p.display_name || '?'
                    WHEN 2 THEN 'when did I last meet anyone at ' || p.company ELSE text END AS question
        FROM (SELECT *, conv_id % 4 AS w, '' AS suffix FROM conversations WHERE conv_id % 4 < 3
              UNION ALL SELECT *, 3, '-own' FROM conversations WHERE text IS NOT NULL)
        JOIN people p ON conv_id % (SELECT count(*) FROM customer) = p.id WHERE role = 'user'""",
    "aliases": """
        SELECT p.tenant_id, 'contacts' AS source_type, 'o' || o_orderkey AS source_record_id,
               o_custkey // 2 AS person_id, 'manual' AS decided_by, NULL::BIGINT AS merged_from_id
        FROM orders JOIN people p ON o_custkey = p.id WHERE o_orderpriority = '1-URGENT'""",
    # Accented letters count as letters at a word's edge; RE2's \b does not know them.
    "plain": r"""
        SELECT qid, tenant_id, trim(question, E' \t\r\n') AS q,
               regexp_replace(trim(question, E' \t\r\n'), '[À-ɏ]', 'z', 'g') AS qa FROM questions""",
    "cued": r"""
        SELECT *, regexp_matches(qa, '(?i)\b(?:work(?:s|ing)?\s+)?at\s+(.+)$')
                  AND regexp_matches(qa, '(?i)\b(who|anyone|any one|people|person|contacts?|connections?|colleagues?)\b') AS c,
               regexp_matches(qa, '(?i)\b(last|recently|most recent)\b.*\b(talk|spoke|speak|chat|met|meet|meeting|email|emailed|contact|saw|see|connect)\w*\b') AS r
        FROM plain""",
    "routed": r"""
        SELECT qid, tenant_id, q AS question,
               CASE WHEN c AND r THEN 'ambiguous' WHEN c THEN 'company' WHEN r THEN 'recency' ELSE 'semantic' END AS intent,
               CASE WHEN c AND NOT r THEN SLOT(regexp_extract(q, '(?i)\b(?:work(?:s|ing)?\s+)?at\s+(.+)$', 1)) END AS company_slot,
               CASE WHEN r AND NOT c THEN SLOT(regexp_extract(q, '(?i)\b(?:talk(?:ed)?\s+to|spoke\s+(?:to|with)|speak\s+(?:to|with)|met\s+with|met|meet|email(?:ed)?|contact(?:ed)?|saw|see|connect(?:ed)?\s+with)\s+(.+)$', 1)) END AS name_slot
        FROM cued""",
    "recency_rows": """
        SELECT i.tenant_id, i.person_id, l.display_name AS person, l.company, l.primary_email AS email, i.source_type,
               i.source_record_id, i.occurred_at, 1.0::DOUBLE AS score,
               trim(i.interaction_type || ' on ' || strftime(i.occurred_at, '%Y-%m-%d') || ': ' || coalesce(i.subject, '')) AS snippet
        FROM interactions i JOIN live l ON i.person_id = l.id AND i.tenant_id = l.tenant_id
        WHERE i.deleted_at IS NULL""",
    "recent": """
        SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at DESC NULLS LAST, source_type, source_record_id) AS place,
               person, company, email, source_type, score, snippet
        FROM recency_rows QUALIFY place <= 8""",
    "live_chunks": "SELECT c.* FROM chunks c JOIN live l ON c.person_id = l.id",
    "chunk_terms": r"""
        SELECT tenant_id, chunk_id, regexp_replace(t, '^(.{3,}?)(ing|ed|es|s)$', '\1') AS stem, count(*) AS tf
        FROM (SELECT tenant_id, chunk_id, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) AS t FROM live_chunks)
        GROUP BY ALL""",
    "question_terms": r"""
        SELECT tenant_id, qid, regexp_replace(t, '^(.{3,}?)(ing|ed|es|s)$', '\1') AS stem, count(*) AS tf
        FROM (SELECT tenant_id, qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM questions)
        GROUP BY ALL""",
    "word_scores": """
        SELECT q.qid, c.chunk_id, sum(q.tf * c.tf)::DOUBLE / sqrt(any_value(qn.n)::DOUBLE * any_value(cn.n)::DOUBLE) AS score
        FROM question_terms q JOIN chunk_terms c ON q.stem = c.stem AND q.tenant_id = c.tenant_id
        JOIN (SELECT qid, sum(tf * tf) AS n FROM question_terms GROUP BY qid) qn ON q.qid = qn.qid
        JOIN (SELECT chunk_id, sum(tf * tf) AS n FROM chunk_terms GROUP BY chunk_id) cn ON c.chunk_id = cn.chunk_id
        GROUP BY q.qid, c.chunk_id
        UNION ALL
        -- chunks with words but none of the question's: score 0, they only fill up the top-k
        SELECT NULL, NULL, NULL WHERE FALSE""",
    "word_hits": """
        SELECT qid, chunk_id, round(s, 4) AS score, place FROM (
            SELECT qid, chunk_id, score AS s, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS place
            FROM word_scores) WHERE place <= 8 AND s >= 0.05""",
    "semantic": """
        SELECT h.qid, h.place, l.display_name AS person, l.company, l.primary_email AS email, c.source_type, h.score,
               c.chunk_text AS snippet
        FROM word_hits h JOIN chunks c ON h.chunk_id = c.chunk_id JOIN live l ON c.person_id = l.id""",
    "answers": """
        SELECT qid, tenant_id, intent, row_number() OVER (PARTITION BY qid ORDER BY branch, place) AS place,
               person, company, email, source_type, score, snippet
        FROM (SELECT * FROM found QUALIFY row_number() OVER (
                  PARTITION BY qid, person, company, snippet, CASE WHEN NOT mixed THEN branch || '-' || place END
                  ORDER BY branch, place) = 1)
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY branch, place) <= 8""",
    "requests": """
        SELECT p.tenant_id, p.id // 2 AS winner_id, p.id AS loser_id
        FROM people p JOIN customer ON c_custkey = p.id WHERE c_acctbal > 7000""",
    "judged": """
        SELECT r.*, CASE WHEN r.winner_id = r.loser_id THEN 'cannot merge a person into themselves'
                         WHEN w.id IS NULL THEN 'winner not found'
                         WHEN l.merged_into_id IS NOT NULL THEN 'loser is already merged'
                         WHEN w.merged_into_id IS NOT NULL THEN 'winner is itself merged away' END AS reason
        FROM requests r LEFT JOIN people w ON r.winner_id = w.id AND r.tenant_id = w.tenant_id
        JOIN people l ON r.loser_id = l.id""",
    # Newest first, no merge is late: a winner is merged away only after its own merges.
    "accepted": "SELECT tenant_id, winner_id, loser_id FROM judged WHERE reason IS NULL",
    "walk": """
        SELECT tenant_id, loser_id AS start, winner_id AS root, loser_id AS last FROM accepted
        UNION ALL
        SELECT w.tenant_id, w.start, a.winner_id, a.loser_id FROM walk w JOIN accepted a ON w.root = a.loser_id""",
    "moves": """
        SELECT tenant_id, start, root, last FROM walk w
        WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.loser_id = w.root)""",
    "merged_sources": """
        SELECT s.tenant_id, s.source_type, s.source_record_id, coalesce(m.root, s.person_id) AS person_id,
               m.root, m.last
        FROM sources s LEFT JOIN moves m ON s.person_id = m.start AND s.tenant_id = m.tenant_id""",
    "merged_aliases": """
        SELECT tenant_id, source_type, source_record_id, root AS person_id, 'manual' AS decided_by, last AS merged_from_id
        FROM merged_sources WHERE root IS NOT NULL
        UNION ALL
        SELECT a.tenant_id, a.source_type, a.source_record_id, a.person_id, a.decided_by, a.merged_from_id FROM aliases a
        WHERE NOT EXISTS (SELECT 1 FROM merged_sources m WHERE m.root IS NOT NULL AND m.tenant_id = a.tenant_id
                          AND m.source_type = a.source_type AND m.source_record_id = a.source_record_id)""",
    "desks": """
        SELECT p.id, p.tenant_id, p.merged_into_id,
               lower('desk' || CAST(floor(c_acctbal / 500) AS BIGINT) || '@' || p.title || '.example') AS email
        FROM live p JOIN customer ON c_custkey = p.id""",
    "asked_company": """
        SELECT r.qid, r.tenant_id, l.id AS person_id, l.primary_email AS email FROM routed r
        JOIN live l ON r.tenant_id = l.tenant_id AND contains(lower(l.company), lower(r.company_slot))
        QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY l.display_name, l.id) <= 8""",
    "relevant": """
        SELECT q.qid, m.id AS person_id FROM questions q JOIN people a ON q.asker = a.id
        JOIN people m ON a.tenant_id = m.tenant_id AND a.company = m.company AND a.title = m.title
        WHERE q.wording = 0""",
    "recalls": """
        SELECT r.qid, count(*) AS relevant, count(h.person_id) AS found, count(h.person_id) / count(*) AS recall
        FROM relevant r LEFT JOIN (SELECT DISTINCT qid, person_id FROM asked_company) h
          ON r.qid = h.qid AND r.person_id = h.person_id GROUP BY r.qid""",
    "statuses": """
        SELECT t.tenant_id, s.ord, s.source_type, s.name, s.auth, s.kind, s.note, coalesce(n.people, 0) AS people,
               y.last_synced_at, t.tenant_id <> 3 AS connected, t.tenant_id = 1 AS expired
        FROM (SELECT DISTINCT tenant_id FROM people) t
        CROSS JOIN (VALUES (0, 'contacts', 'Google Contacts', 'google', 'oauth', NULL),
                           (1, 'gmail', 'Gmail', 'google', 'oauth', 'metadata only · headers'),
                           (2, 'calendar', 'Calendar', 'google', 'oauth', 'not connected'),
                           (3, 'linkedin', 'LinkedIn', NULL, 'upload', 'CSV import')) s(ord, source_type, name, auth, kind, note)
        LEFT JOIN (SELECT tenant_id, source_type, count(DISTINCT person_id) AS people FROM sources
                   WHERE source_type <> 'linkedin' OR tenant_id <> 2 GROUP BY ALL) n USING (tenant_id, source_type)
        LEFT JOIN (SELECT tenant_id, source_type, max(occurred_at) AS last_synced_at FROM interactions GROUP BY ALL) y
          USING (tenant_id, source_type)""",
    "status_rows": """
        SELECT *, CASE WHEN auth IS NOT NULL AND connected AND expired THEN 'reconnect'
                       WHEN auth IS NOT NULL AND connected THEN 'on'
                       WHEN auth IS NULL AND people > 0 THEN 'on' ELSE 'off' END AS status FROM statuses""",
    "addressed": """
        SELECT o_orderkey, lower(CASE o_orderpriority WHEN '1-URGENT' THEN 'No-Reply+' || o_custkey
                WHEN '2-HIGH' THEN 'Calendar-' || o_custkey WHEN '3-MEDIUM' THEN 'Clerk.' || o_custkey
                WHEN '4-NOT SPECIFIED' THEN 'calendar' ELSE 'dev' || o_custkey || '-request-s' END
               || '@' || CASE o_orderstatus WHEN 'F' THEN 'Bounce.Example.com' ELSE 'example.com' END) AS email,
               o_orderpriority <> '3-MEDIUM' OR o_orderstatus = 'F' AS non_human
        FROM orders""",
    "branded": """
        SELECT p_partkey, p_size, upper(p_name) AS name,
               p_brand || CASE p_size % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Co. Ltd' WHEN 2 THEN ' GmbH & Partners'
                          WHEN 3 THEN '  (Corporation)' ELSE '' END AS company,
               lower(replace(p_brand, '#', ' ')) || CASE p_size % 5 WHEN 2 THEN ' gmbh partners' ELSE '' END AS plain
        FROM part""",
    "order_mail": """
        SELECT p.tenant_id, o.*, p.display_name, p.primary_email,
               CASE WHEN o_orderstatus = 'P' THEN '(no subject)' ELSE 'Order ' || o_orderkey END AS subject,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS occurred
        FROM orders o JOIN people p ON o_custkey = p.id""",
    "pending": """
        SELECT 0 AS tenant_id, source AS source_record_id, text, doc_id AS pos, sha256(text) AS content_hash FROM documents""",
    "stored": "SELECT DISTINCT source_record_id, content_hash FROM pending JOIN labels ON pos = doc_id",
    "order_rows": """
        SELECT p.tenant_id, 'o' || o_orderkey AS source_record_id, o_orderpriority, o_custkey,
               CASE WHEN o_orderstatus = 'P' THEN 'new.' ELSE '' END || p.primary_email AS email,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE p.id END AS email_person,
               CASE WHEN o_orderpriority = '1-URGENT' AND h.tenant_id = p.tenant_id THEN h.id END AS alias_person,
               o_orderkey
        FROM orders JOIN people p ON o_custkey = p.id JOIN people h ON o_custkey // 2 = h.id""",
    "roots": """
        SELECT id, merged_into_id AS root FROM people WHERE merged_into_id IS NOT NULL
        UNION ALL
        SELECT r.id, p.merged_into_id FROM roots r JOIN people p ON r.root = p.id WHERE p.merged_into_id IS NOT NULL""",
    "ends": """
        SELECT r.id, r.root FROM roots r JOIN people p ON r.root = p.id WHERE p.merged_into_id IS NULL""",
    "late_chain": """
        SELECT a.loser_id, a.loser_id AS hop, 0 AS depth FROM accepted a
        UNION ALL
        SELECT c.loser_id, a.winner_id, c.depth + 1 FROM late_chain c JOIN accepted a ON c.hop = a.loser_id
        JOIN accepted b ON b.loser_id = a.winner_id""",
}

SLOT = r"""nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(
    trim(trim({x}), '"'''), '[\s?.!,]+$', ''), '(?is)\b(?:in|about|regarding|re|on|for)\b.*', '')),
    '(?i)^(?:with|to)\s+', '')), '')"""


def _expand(sql: str) -> str:
    """Replace SLOT(x) by the cleaning expression; the calls are not nested."""
    out, rest = "", sql
    while "SLOT(" in rest:
        before, rest = rest.split("SLOT(", 1)
        depth, i = 1, 0
        quoted = False
        while depth:
            ch = rest[i]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += {"(": 1, ")": -1}.get(ch, 0)
            i += 1
        out += before + SLOT.replace("{x}", rest[: i - 1])
        rest = rest[i:]
    return out + rest


def _sql(names: str, body: str, **extra: str) -> str:
    """``body`` below WITH, with the named base tables in the given order and ``extra`` ones last."""
    ctes = [f"{n} AS ({BASE[n]})" for n in names.split()]
    late = {n for n in ("answers",) if n in names.split()}
    parts = [c for c in ctes if c.split(" ", 1)[0] not in late]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    parts += [c for c in ctes if c.split(" ", 1)[0] in late]
    return _expand(f"WITH RECURSIVE {', '.join(parts)} {body}")


_COMPANY_SLOTS = """
    SELECT s.tenant_id, s.slot, row_number() OVER (PARTITION BY s.tenant_id, s.slot ORDER BY l.display_name, l.id) AS place,
           l.display_name AS person, l.company, l.primary_email AS email, 'contacts' AS source_type, 1.0::DOUBLE AS score,
           l.display_name || ' — ' || l.title || ' at ' || l.company AS snippet
    FROM (SELECT DISTINCT tenant_id, slot FROM slots) s
    JOIN live l ON s.tenant_id = l.tenant_id AND contains(lower(l.company), s.slot) QUALIFY place <= 8"""
_NAME_SLOTS = """
    SELECT s.tenant_id, s.slot, row_number() OVER (PARTITION BY s.tenant_id, s.slot
               ORDER BY occurred_at DESC NULLS LAST, source_type, source_record_id) AS place,
           person, company, email, source_type, score, snippet
    FROM (SELECT DISTINCT tenant_id, slot FROM name_slots) s
    JOIN recency_rows r ON s.tenant_id = r.tenant_id AND contains(lower(r.person), lower(s.slot)) QUALIFY place <= 8"""
_FOUND = """
    SELECT a.qid, a.tenant_id, a.intent, a.mixed, 0 AS branch, c.place, c.person, c.company, c.email, c.source_type, c.score, c.snippet
    FROM asked a JOIN by_company c ON a.tenant_id = c.tenant_id AND a.company_slot = c.slot
    UNION ALL
    SELECT a.qid, a.tenant_id, a.intent, a.mixed, 1, c.place, c.person, c.company, c.email, c.source_type, c.score, c.snippet
    FROM asked a JOIN by_name c ON a.tenant_id = c.tenant_id AND a.name_slot = c.slot
    UNION ALL
    SELECT a.qid, a.tenant_id, a.intent, a.mixed, 1, c.place, c.person, c.company, c.email, c.source_type, c.score, c.snippet
    FROM asked a JOIN recent c ON a.tenant_id = c.tenant_id
    WHERE (a.mixed OR a.intent = 'recency') AND a.name_slot IS NULL
    UNION ALL
    SELECT a.qid, a.tenant_id, a.intent, a.mixed, 2, c.place, c.person, c.company, c.email, c.source_type, c.score, c.snippet
    FROM asked a JOIN semantic c ON a.qid = c.qid WHERE a.mixed OR a.intent = 'semantic'"""
_ROUTE_TABLES = (
    "people live interactions chunks questions plain cued routed recency_rows recent live_chunks chunk_terms "
    "question_terms word_scores word_hits semantic answers"
)
_ROUTED = dict(
    asked="""SELECT qid, tenant_id, CASE intent WHEN 'ambiguous' THEN 'hybrid' ELSE intent END AS intent, company_slot, name_slot,
                    intent = 'ambiguous' OR (intent = 'company' AND company_slot IS NULL) AS mixed FROM routed""",
    slots="SELECT tenant_id, company_slot AS slot FROM asked WHERE company_slot IS NOT NULL",
    name_slots="SELECT tenant_id, name_slot AS slot FROM asked WHERE name_slot IS NOT NULL",
    by_company=_COMPANY_SLOTS,
    by_name=_NAME_SLOTS,
    found=_FOUND,
)
_HYBRID = {
    **_ROUTED,
    "asked": """SELECT q.qid, q.tenant_id, 'hybrid' AS intent, lower(p.company) AS company_slot, NULL::VARCHAR AS name_slot,
                       TRUE AS mixed FROM questions q JOIN people p ON q.asker = p.id""",
}


def _vector_sql(keys: str, qid: str) -> str:
    return _sql(
        "people live vectors",
        f"""SELECT qid, chunk_id, round(s, 4) AS score, place FROM (
              SELECT q.qid, v.chunk_id, list_cosine_similarity(v.embedding, q.embedding) AS s,
                     row_number() OVER (PARTITION BY q.qid ORDER BY list_cosine_similarity(v.embedding, q.embedding) DESC, v.chunk_id) AS place
              FROM asked q JOIN vectors v ON q.tenant_id = v.tenant_id JOIN live l ON v.person_id = l.id)
            WHERE place <= 8 AND s >= 0.05""",
        elements="SELECT tenant_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM vectors",
        means=f"SELECT {keys}, i, avg(x) AS x FROM elements GROUP BY ALL",
        asked=f"SELECT {keys}, {qid} AS qid, list(x ORDER BY i) AS embedding FROM means GROUP BY {keys}",
    )


ORACLE: dict[str, str] = {
    "recency_topk": _sql("people live interactions recency_rows recent", "SELECT * FROM recent"),
    "recency_topk_by_name": _sql(
        "people live interactions recency_rows",
        "SELECT * FROM by_name",
        name_slots="SELECT tenant_id, lower(display_name) AS slot FROM live",
        by_name=_NAME_SLOTS,
    ),
    "company_lookup": _sql(
        "people live",
        "SELECT * FROM by_company",
        slots="SELECT tenant_id, lower(substr(company, 2, 5)) AS slot FROM people",
        by_company=_COMPANY_SLOTS,
    ),
    "people_page": _sql(
        "people live",
        """SELECT id, display_name, primary_email, company, title FROM live WHERE tenant_id = 1
           ORDER BY display_name NULLS LAST, id LIMIT 50 OFFSET 40""",
    ),
    "tenant_write": _sql("people", "SELECT tenant_id, company, count(*) AS n FROM people WHERE tenant_id = 2 GROUP BY ALL"),
    "recent_per_person": _sql(
        "people interactions",
        """SELECT i.tenant_id, i.person_id, p.display_name,
                  row_number() OVER (PARTITION BY i.tenant_id, i.person_id
                     ORDER BY occurred_at DESC NULLS LAST, source_type, source_record_id) AS place,
                  source_type, interaction_type, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, subject
           FROM interactions i JOIN people p ON i.person_id = p.id WHERE deleted_at IS NULL QUALIFY place <= 20""",
    ),
    "person_provenance": _sql(
        "people interactions sources",
        """SELECT p.tenant_id, p.id AS person_id, p.display_name, p.primary_email, p.company, p.title, p.merged_into_id,
                  s.source_type, s.source_record_id, s.matched_confidence
           FROM people p LEFT JOIN sources s ON p.id = s.person_id AND p.tenant_id = s.tenant_id""",
    ),
    "person_source_lists": _sql(
        "people interactions sources",
        """SELECT p.tenant_id, p.id AS person_id, p.display_name, p.company, p.primary_email,
                  coalesce(string_agg(DISTINCT s.source_type, ',' ORDER BY s.source_type), '') AS sources,
                  count(s.source_type) AS n_records
           FROM people p LEFT JOIN sources s ON p.id = s.person_id GROUP BY ALL""",
    ),
    "semantic_topk": _vector_sql("tenant_id", "tenant_id"),
    "semantic_topk_batch": _vector_sql("tenant_id, label", "tenant_id * 1000 + label"),
    "words_topk": _sql(
        "people live chunks questions live_chunks chunk_terms question_terms word_scores word_hits",
        "SELECT qid, chunk_id, score, place FROM word_hits",
    ),
    "question_routing": _sql("people questions plain cued routed", "SELECT qid, intent, company_slot, name_slot FROM routed"),
    "routed_answers": _sql(_ROUTE_TABLES, "SELECT * FROM answers", **_ROUTED),
    "hybrid_union": _sql(_ROUTE_TABLES, "SELECT * EXCLUDE (intent) FROM answers", **_HYBRID),
    "context_lines": _sql(
        _ROUTE_TABLES,
        """SELECT q.qid, coalesce(string_agg('[' || place || '] ' || person || ' at ' || company || ' (via '
                  || upper(source_type[1]) || source_type[2:] || '): ' || snippet, E'\\n' ORDER BY place),
                  'I don''t have anything matching that in your network yet. Connect a source and run a sync first.') AS context
           FROM questions q LEFT JOIN answers a ON q.qid = a.qid GROUP BY q.qid""",
        **_ROUTED,
    ),
    "citation_dedupe": _sql(
        "people live interactions",
        """SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY branch, pos) AS place, person, company, snippet
           FROM (SELECT i.person_id AS qid, CASE source_type WHEN 'gmail' THEN 0 ELSE 1 END AS branch,
                        external_id::BIGINT AS pos, l.display_name AS person, l.company, i.subject AS snippet
                 FROM interactions i JOIN live l ON i.person_id = l.id
                 QUALIFY row_number() OVER (PARTITION BY i.person_id, i.subject
                                            ORDER BY CASE source_type WHEN 'gmail' THEN 0 ELSE 1 END, external_id::BIGINT) = 1)
           QUALIFY place <= 8""",
    ),
    "network_counts": _sql(
        "people live chunks",
        """SELECT tenant_id, (SELECT count(*) FROM live l WHERE l.tenant_id = t.tenant_id) AS people,
                  (SELECT count(*) FROM chunks c WHERE c.tenant_id = t.tenant_id) AS chunks
           FROM (SELECT DISTINCT tenant_id FROM people) t""",
    ),
    "people_per_source": _sql(
        "people interactions sources",
        "SELECT tenant_id, source_type, count(DISTINCT person_id) AS people FROM sources GROUP BY ALL",
    ),
    "source_status": _sql(
        "people interactions sources statuses status_rows",
        """SELECT tenant_id, ord, source_type, name, status, people,
                  CASE WHEN status = 'reconnect' THEN 'access expired · reconnect'
                       WHEN status = 'on' AND people > 0 THEN format('{:,}', people) || ' people'
                            || coalesce(' · synced ' || AGE, '')
                       WHEN status = 'on' THEN 'connected · run a sync' ELSE coalesce(note, 'not connected') END AS meta,
                  kind, CASE WHEN status = 'on' THEN 're-sync' WHEN status = 'reconnect' THEN 'reconnect'
                             WHEN kind = 'upload' THEN 'import' ELSE 'connect' END AS action
           FROM status_rows""",
    ),
    "sync_cursors": _sql(
        "people interactions",
        """SELECT tenant_id, source_type, cursor, strftime(synced, '%Y-%m-%d %H:%M:%S') AS last_synced_at FROM (
             SELECT tenant_id, source_type, arg_max(external_id, external_id::BIGINT) FILTER (deleted_at IS NULL) AS cursor,
                    coalesce(arg_max(occurred_at, external_id::BIGINT) FILTER (deleted_at IS NULL), max(occurred_at)) AS synced
             FROM interactions GROUP BY ALL)""",
    ),
    "age_labels": "SELECT event_id, AGE AS age FROM (SELECT event_id, ts AS last_synced_at FROM events)",
    "email_normalise": _sql("addressed", "SELECT o_orderkey, email FROM addressed"),
    "non_human_filter": _sql("addressed", "SELECT o_orderkey, non_human FROM addressed"),
    "company_normalise": _sql("branded", "SELECT p_partkey, plain AS company, lower(name) AS name FROM branded"),
    "stable_ids": _sql(
        "branded",
        """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://people.example/' || p_partkey
                  ELSE 'linkedin:' || substr(sha256(lower(name || '|' || company)), 1, 16) END AS stable_id FROM branded""",
    ),
    "term_vectors": r"""
        SELECT doc_id, stem, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
            SELECT doc_id, regexp_replace(t, '^(.{3,}?)(ing|ed|es|s)$', '\1') AS stem, count(*) AS tf
            FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY ALL)""",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "message_fanout": _sql(
        "people order_mail",
        """SELECT tenant_id, o_orderkey || '#' || lower(address) AS source_record_id, name AS display_name, address AS primary_email,
                  'Email ''' || subject || ''' with ' || name AS text, CAST(o_orderkey AS VARCHAR) AS external_id,
                  CASE o_orderstatus WHEN 'F' THEN 'email_sent' ELSE 'email_received' END AS interaction_type,
                  occurred AS occurred_at, subject, pos
           FROM (SELECT *, display_name AS name, CASE o_orderstatus WHEN 'F' THEN primary_email ELSE upper(primary_email) END AS address,
                        CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS pos FROM order_mail
                 UNION ALL
                 SELECT *, 'Clerk, ' || o_orderpriority, 'clerk' || o_orderpriority[1] || '@office.example',
                        CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END FROM order_mail)""",
    ),
    "first_participants": """
        SELECT l_orderkey AS external_id, 'S' || (l_suppkey % 7) || '@x.example' AS primary_email,
               CAST(l_linenumber AS BIGINT) AS linenumber, l_suppkey AS suppkey, l_partkey AS partkey
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 7
                                                 ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""",
    "bulk_load_cap": """
        SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS listed_at FROM orders
        ORDER BY o_orderdate, o_orderkey LIMIT 500""",
    "bulk_load": """
        SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS listed_at FROM orders""",
    "change_collapse": """
        WITH changes AS (
            SELECT l_suppkey % 5 AS tenant_id, CASE l_returnflag WHEN 'R' THEN 'deleted' ELSE 'added' END AS op,
                   CAST(l_orderkey AS VARCHAR) AS message_id, l_orderkey * 1000 + l_linenumber AS history_id,
                   l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
        SELECT tenant_id, op, message_id, min(pos) AS pos, any_value(cursor) AS cursor
        FROM changes JOIN (SELECT tenant_id, max(history_id) AS cursor FROM changes GROUP BY ALL) USING (tenant_id)
        GROUP BY tenant_id, op, message_id""",
    "distinct_in_order": "SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL",
    "calendar_fanout": _sql(
        "people",
        """SELECT p.tenant_id, event_id || '#' || p.primary_email AS source_record_id, NULL::VARCHAR AS display_name,
                  upper(p.primary_email) AS primary_email,
                  'Meeting ''' || CASE event_type WHEN 'view' THEN '(no title)' ELSE event_type END || ''' with ' || upper(p.primary_email) AS text,
                  CAST(event_id AS VARCHAR) AS external_id, 'meeting' AS interaction_type,
                  CASE event_type WHEN 'signup' THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS occurred_at,
                  CASE event_type WHEN 'view' THEN '(no title)' ELSE event_type END AS subject, 0 AS pos
           FROM events JOIN people p ON user_id = p.id WHERE event_type <> 'error' AND ts >= DATE '2000-01-01'""",
    ),
    "calendar_cancelled": _sql(
        "people",
        """SELECT p.tenant_id, 'calendar' AS source_type, CAST(event_id AS VARCHAR) AS external_id
           FROM events JOIN people p ON user_id = p.id WHERE event_type = 'error'""",
    ),
    "contact_records": _sql(
        "people",
        """SELECT CAST(tenant_id AS VARCHAR) AS tenant_id, 'contacts' AS source_type, 'people/' || id AS source_record_id, name AS display_name,
                  email AS primary_email, co AS company, ti AS title,
                  coalesce(nullif(concat_ws(' — ', name, ti, co), ''), email, '') AS text
           FROM (SELECT *, CASE WHEN id % 7 <> 0 THEN display_name END AS name,
                        CASE WHEN id % 21 = 0 THEN NULL WHEN id % 2 = 0 THEN primary_email ELSE 'old.' || primary_email END AS email,
                        CASE WHEN id % 3 <> 0 THEN company END AS co, CASE WHEN id % 3 <> 0 THEN title END AS ti FROM people)
           WHERE name IS NOT NULL OR email IS NOT NULL""",
    ),
    "connection_records": """
        WITH s AS (SELECT CAST(n_regionkey AS VARCHAR) AS tenant_id, s_name, s_suppkey, 'Works, of' || chr(10) || n_name AS company
                   FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT tenant_id, 'linkedin' AS source_type,
               'linkedin:' || substr(sha256(lower('Sam ' || s_name || '|' || company)), 1, 16) AS source_record_id,
               'Sam ' || s_name AS display_name, NULL::VARCHAR AS primary_email, company, 'Buyer' AS title,
               'Sam ' || s_name || ' — Buyer — ' || company AS text FROM s
        UNION ALL
        SELECT tenant_id, 'linkedin', 'https://people.example/' || s_suppkey, 'Ann Lee ' || s_suppkey,
               'ann' || s_suppkey || '@x.example', NULL, NULL, 'Ann Lee ' || s_suppkey FROM s""",
    "text_decoding": r"""
        SELECT doc_id, sha256(CASE WHEN lang = 'en' THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END) AS hash
        FROM documents""",
    "dead_letter_split": """
        SELECT '0' AS tenant_id, 'pages' AS source_type, CAST(page_id AS VARCHAR) AS source_record_id,
               CASE WHEN starts_with(url, 'https') THEN 'stored' ELSE 'parse' END AS stage,
               CASE WHEN starts_with(url, 'https') THEN ''
                    ELSE 'ValueError: ' || substr('not secure: ' || url || repeat(' tail', 80), 1, 300) || '…' END AS reason
        FROM pages""",
    "upsert_latest": """
        WITH line AS (SELECT l_orderkey, l_suppkey, l_discount FROM lineitem WHERE l_returnflag = 'R'
                      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC,
                                                 l_suppkey DESC, l_discount DESC) = 1)
        SELECT 0 AS tenant_id, 'contacts' AS source_type, CAST(coalesce(l_orderkey, o_orderkey) AS VARCHAR) AS source_record_id,
               CASE WHEN l_orderkey IS NULL THEN o_custkey ELSE l_suppkey END AS person_id,
               CASE WHEN l_orderkey IS NULL THEN 'order' ELSE 'line' END AS raw, round(l_discount, 2) AS matched_confidence
        FROM orders FULL JOIN line ON o_orderkey = l_orderkey""",
    "upsert_undelete": _sql(
        "people interactions",
        """SELECT tenant_id, source_type, source_record_id, person_id, interaction_type,
                  CASE WHEN interaction_type = 'error' AND person_id % 2 = 0 THEN 'again' ELSE subject END AS subject,
                  interaction_type = 'error' AND person_id % 2 <> 0 AS deleted FROM interactions""",
    ),
    "apply_deletions": _sql(
        "people interactions",
        """SELECT tenant_id, source_record_id,
                  CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderkey AS VARCHAR) = external_id)
                       THEN '2024-02-01 00:00:00' ELSE strftime(deleted_at, '%Y-%m-%d %H:%M:%S') END AS deleted_at
           FROM interactions""",
    ),
    "delete_chunks": _sql(
        "people chunks",
        """SELECT tenant_id, source_record_id, content_hash FROM chunks
           WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    ),
    "absent_reconcile": _sql(
        "people interactions",
        """SELECT DISTINCT tenant_id, source_type, external_id FROM interactions
           WHERE external_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O')""",
    ),
    "unchanged_texts": _sql(
        "pending stored",
        """SELECT pos, CASE WHEN s.content_hash IS NULL THEN 'embed' ELSE 'skip' END AS fate
           FROM pending p LEFT JOIN stored s USING (source_record_id, content_hash) WHERE trim(text) <> ''""",
    ),
    "insert_absent_chunks": _sql(
        "pending stored",
        """SELECT source_record_id, content_hash, min(pos) AS pos FROM pending ANTI JOIN stored USING (source_record_id, content_hash)
           GROUP BY ALL""",
    ),
    "alias_then_email": _sql("people order_rows", "SELECT tenant_id, source_record_id, email, alias_person, email_person FROM order_rows"),
    "resolve_orders": _sql(
        "people order_rows roots ends",
        """SELECT tenant_id, source_record_id,
                  CASE WHEN alias_person IS NOT NULL THEN 'alias' WHEN email_person IS NOT NULL THEN 'email'
                       WHEN nr = 1 THEN 'provisional' ELSE 'email' END AS outcome,
                  alias_person IS NULL AND email_person IS NULL AND nr = 1 AS created,
                  CASE WHEN alias_person IS NOT NULL OR email_person IS NOT NULL
                       THEN CAST(coalesce(e.root, alias_person, email_person) AS VARCHAR)
                       WHEN nr > 1 THEN substr(sha256(tenant_id || chr(1) || 'contacts' || chr(1) || 'o' || first_key), 1, 32) END AS known_person,
                  CASE WHEN alias_person IS NULL THEN email END AS email
           FROM (SELECT *, row_number() OVER (PARTITION BY email, alias_person IS NULL ORDER BY o_orderkey) AS nr,
                        min(o_orderkey) OVER (PARTITION BY email, alias_person IS NULL) AS first_key
                 FROM order_rows) o
           LEFT JOIN ends e ON e.id = coalesce(alias_person, email_person)""",
    ),
    "merge_verdicts": _sql(
        "people requests judged accepted late_chain",
        """SELECT j.tenant_id, j.winner_id, j.loser_id, j.reason IS NULL AND d.depth % 2 = 0 AS accepted,
                  CASE WHEN j.reason IS NULL AND d.depth % 2 = 1 THEN 'winner or loser was merged away by an earlier merge'
                       ELSE j.reason END AS reason
           FROM judged j LEFT JOIN (SELECT loser_id, max(depth) AS depth FROM late_chain GROUP BY ALL) d USING (loser_id)""",
    ),
    "merge_sources": _sql(
        "people interactions sources requests judged accepted walk moves merged_sources",
        "SELECT tenant_id, source_type, source_record_id, person_id FROM merged_sources",
    ),
    "merge_aliases": _sql(
        "people interactions sources aliases requests judged accepted walk moves merged_sources merged_aliases",
        "SELECT * FROM merged_aliases",
    ),
    "merge_tombstones": _sql(
        "people requests judged accepted",
        """SELECT p.tenant_id, p.id, coalesce(p.merged_into_id, a.winner_id) AS merged_into_id
           FROM people p LEFT JOIN accepted a ON p.id = a.loser_id""",
    ),
    "unmerge_sources": _sql(
        "people interactions sources aliases requests judged accepted walk moves merged_sources merged_aliases",
        """SELECT s.tenant_id, s.source_type, s.source_record_id, coalesce(a.merged_from_id, s.person_id) AS person_id
           FROM merged_sources s LEFT JOIN merged_aliases a ON s.tenant_id = a.tenant_id AND s.source_type = a.source_type
             AND s.source_record_id = a.source_record_id AND a.merged_from_id % 2 = 0""",
    ),
    "live_roots": _sql("people roots ends", "SELECT id, root FROM ends"),
    "shared_email_groups": _sql(
        "people live desks",
        """SELECT tenant_id, email, id AS person_id, min(id) OVER w AS first_id, count(*) OVER w AS group_size
           FROM desks WINDOW w AS (PARTITION BY tenant_id, email) QUALIFY group_size > 1""",
    ),
    "shared_email_pairs": _sql(
        "people live desks",
        """SELECT a.tenant_id, a.id AS a_id, b.id AS b_id, 1.0::DOUBLE AS score, 'shared email' AS reason
           FROM desks a JOIN desks b ON a.tenant_id = b.tenant_id AND a.email = b.email AND a.id < b.id
           QUALIFY row_number() OVER (PARTITION BY a.tenant_id ORDER BY a.id, b.id) <= 25""",
    ),
    "pair_dedupe": """
        SELECT least(l_suppkey % 50, l_partkey % 50) AS low, greatest(l_suppkey % 50, l_partkey % 50) AS high,
               min(l_orderkey * 10 + l_linenumber) AS line
        FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50 GROUP BY ALL""",
    "recall_at_k": _sql(
        "people live questions plain cued routed asked_company relevant recalls",
        "SELECT qid, relevant, found, round(recall, 6) AS recall FROM recalls",
    ),
    "mean_recall": _sql(
        "people live questions plain cued routed asked_company relevant recalls",
        "SELECT count(*) AS questions, round(avg(recall), 6) AS mean_recall FROM recalls",
    ),
    "intent_accuracy": _sql(
        "people questions plain cued routed",
        """SELECT count(*) AS questions,
                  round(avg(CASE WHEN intent = ['company', 'recency', 'ambiguous', 'semantic'][1 + q.wording] THEN 1.0 ELSE 0.0 END), 6) AS accuracy
           FROM routed JOIN questions q USING (qid)""",
    ),
    "zero_result": _sql(
        "people live questions plain cued routed asked_company",
        "SELECT qid, count(*) AS hits FROM asked_company WHERE tenant_id = 4 GROUP BY ALL",
    ),
    "ungrounded": _sql(
        "people",
        "SELECT tenant_id, id AS qid, upper(primary_email) AS email FROM people WHERE merged_into_id IS NOT NULL",
    ),
    "reembed_chunks": r"""
        WITH cells AS (
            SELECT chunk_id, bucket, sum(tf)::DOUBLE AS n FROM (
                SELECT doc_id AS chunk_id, regexp_replace(t, '^(.{3,}?)(ing|ed|es|s)$', '\1') AS stem, count(*) AS tf
                FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents
                      WHERE doc_id % (SELECT count(*) FROM customer) IN (SELECT c_custkey FROM customer)) GROUP BY ALL),
                LATERAL (SELECT CAST(('0x' || substr(md5(stem), 1, 8)) AS BIGINT) % 64 AS bucket)
            GROUP BY ALL)
        SELECT chunk_id, bucket, round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS FLOAT)::DOUBLE, 4) AS value FROM cells""",
    "stream_sync_replay": _sql(
        "people",
        """SELECT CAST(p.tenant_id AS VARCHAR) AS tenant_id, event_id || '#' || p.primary_email AS source_record_id,
                  CAST(coalesce(e.root, p.id) AS VARCHAR) AS person_id, event_type AS interaction_type,
                  strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at, event_type = 'error' AS deleted
           FROM events JOIN people p ON user_id = p.id LEFT JOIN ends e ON e.id = p.id""",
        roots=BASE["roots"],
        ends=BASE["ends"],
    ),
}

# Two rows a message, as ``message_fanout`` makes them.
_MAIL_ROWS = """
        SELECT CAST(tenant_id AS VARCHAR) AS tenant_id, o_orderkey, o_orderkey || '#' || lower(address) AS source_record_id,
               CASE o_orderstatus WHEN 'F' THEN 'email_sent' ELSE 'email_received' END AS interaction_type,
               occurred AS occurred_at, subject
        FROM (SELECT *, primary_email AS address FROM order_mail
              UNION ALL SELECT *, 'clerk' || o_orderpriority[1] || '@office.example' FROM order_mail)"""
_LATE_CHANGES = """
        SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS flag
        FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL"""
ORACLE["message_sync"] = _sql(
    "people order_mail",
    """SELECT tenant_id, source_record_id, interaction_type, occurred_at, subject, coalesce(flag = 'R', false) AS deleted
       FROM mail_rows LEFT JOIN late ON o_orderkey = l_orderkey
       WHERE o_orderkey % 7 <> 0 OR (flag <> 'R' AND o_orderkey % 11 <> 0)""",
    mail_rows=_MAIL_ROWS,
    late=_LATE_CHANGES,
)
ORACLE["sync_with_fallback"] = _sql(
    "people order_mail",
    """SELECT tenant_id, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS deleted,
              count(*) FILTER (stale AND NOT deleted) AS stale, '9000000000' AS cursor
       FROM (SELECT tenant_id, false AS deleted, false AS stale
             FROM mail_rows LEFT JOIN late ON o_orderkey = l_orderkey
             WHERE o_orderkey % 11 <> 0 AND (tenant_id NOT IN ('2', '3') OR flag <> 'R')
             UNION ALL
             SELECT CAST(tenant_id AS VARCHAR), tenant_id NOT IN (2, 3), true FROM people)
       GROUP BY tenant_id""",
    mail_rows=_MAIL_ROWS,
    late=_LATE_CHANGES,
)
ORACLE["calendar_sync"] = _sql(
    "people",
    """SELECT tenant_id, source_record_id, occurred_at, subject, deleted FROM (
           SELECT l.*, coalesce(n.off, false) AND l.round = 0 AS deleted, m.source_record_id IS NOT NULL AND l.round = 0 AS replaced
           FROM versions l
           LEFT JOIN versions n ON n.round = 1 AND n.tenant_id = l.tenant_id AND n.meeting = l.meeting
           LEFT JOIN versions m ON m.round = 1 AND m.tenant_id = l.tenant_id AND m.source_record_id = l.source_record_id AND NOT m.off
           WHERE NOT l.off)
       WHERE NOT replaced""",
    versions="""
        SELECT CAST(p.tenant_id AS VARCHAR) AS tenant_id, event_id % half AS meeting, event_id // half AS round,
               (event_id % half) || '#' || p.primary_email AS source_record_id, event_type = 'error' AS off,
               CASE event_type WHEN 'signup' THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS occurred_at,
               CASE event_type WHEN 'view' THEN '(no title)' ELSE event_type END AS subject
        FROM events JOIN people p ON user_id = p.id, (SELECT max(event_id) // 2 + 1 AS half FROM events)""",
)
ORACLE["contacts_sync"] = f"""
    SELECT tenant_id, source_record_id, nullif(text, '') AS chunk_text FROM ({ORACLE["contact_records"]})"""

ORACLE["ingest_order_counters"] = _sql(
    "people order_rows",
    """SELECT tenant_id, 'contacts' AS source_type, count(*) FILTER (made AND NOT bad) AS people_created,
              count(*) FILTER (NOT made AND NOT bad) AS people_matched, count(*) FILTER (NOT bad) AS sources_upserted,
              count(*) FILTER (NOT bad AND NOT known) AS chunks_embedded, count(*) FILTER (NOT bad AND known) AS chunks_skipped,
              count(*) FILTER (bad) AS errors, CAST(0 AS BIGINT) AS deletions
       FROM (SELECT *, o_orderkey % 5 = 0 AS known,
                    alias_person IS NULL AND email_person IS NULL
                    AND row_number() OVER (PARTITION BY bad, email, alias_person IS NULL ORDER BY o_orderkey) = 1 AS made
             FROM (SELECT *, o_orderkey % 13 = 0 AS bad FROM order_rows))
       GROUP BY tenant_id""",
)
ORACLE["sync_all_sources"] = _sql(
    "people",
    """SELECT 'gmail' AS source, true AS ok, NULL::VARCHAR AS message, count(*) AS stored
       FROM (SELECT DISTINCT p.tenant_id, event_id, p.primary_email FROM events JOIN people p ON user_id = p.id)
       UNION ALL SELECT 'contacts', true, NULL, count(*)
       FROM (SELECT DISTINCT p.tenant_id, o_orderkey FROM orders JOIN people p ON o_custkey = p.id)
       UNION ALL SELECT 'calendar', false, 'RuntimeError: no export has landed', 0""",
)

_AGE = """(CASE WHEN last_synced_at IS NULL THEN NULL
                WHEN epoch(TIMESTAMP '2024-02-01') - epoch(last_synced_at) < 90 THEN 'just now'
                WHEN epoch(TIMESTAMP '2024-02-01') - epoch(last_synced_at) < 3600
                  THEN CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(last_synced_at)) / 60) AS BIGINT) || 'm ago'
                WHEN epoch(TIMESTAMP '2024-02-01') - epoch(last_synced_at) < 86400
                  THEN CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(last_synced_at)) / 3600) AS BIGINT) || 'h ago'
                ELSE CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(last_synced_at)) / 86400) AS BIGINT) || 'd ago' END)"""
for _name in ("source_status", "age_labels"):
    ORACLE[_name] = ORACLE[_name].replace("AGE AS age", f"{_AGE} AS age").replace("|| AGE", f"|| {_AGE}")
