from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators import governance
from kinweave.sources import calendar, connections, contacts, deadletter, messages


def mail(headers, mid="m1", when="1700000000000"):
    return ("t", mid, when, (list(headers.items()),))


def own(spark):
    return spark.createDataFrame([("t", "Me@example.com")], "tenant_id STRING, email STRING")


def fan_out(spark, *rows):
    return messages.message_participants(spark.createDataFrame(list(rows), schemas.MESSAGES), own(spark)).collect()


def test_received_mail_fans_out_and_skips_the_owner(spark):
    rows = fan_out(spark, mail({"From": "Sarah Chen <sarah@stripe.com>", "To": "me@example.com, Raj <raj@stripe.com>", "Subject": "Integration review"}))
    assert {r.primary_email for r in rows} == {"sarah@stripe.com", "raj@stripe.com"}
    assert {r.interaction_type for r in rows} == {"email_received"}
    assert {r.subject for r in rows} == {"Integration review"}
    assert all(r.source_record_id.startswith("m1#") and r.occurred_at is not None for r in rows)


def test_sent_mail_and_text(spark):
    rows = fan_out(spark, mail({"from": "me@example.com", "TO": "Sarah <sarah@stripe.com>", "subject": "Q3 planning"}))
    assert [(r.interaction_type, r.text) for r in rows] == [("email_sent", "Email 'Q3 planning' with Sarah")]


def test_repeated_address_counts_once_first_spelling_stays(spark):
    rows = fan_out(spark, mail({"From": "A <X@y.com>", "To": "x@y.com", "Cc": "B <x@Y.com>, c@y.com"}, when="soon"))
    assert [(r.pos, r.primary_email, r.display_name, r.source_record_id) for r in sorted(rows, key=lambda r: r.pos)] == [
        (0, "X@y.com", "A", "m1#x@y.com"), (1, "c@y.com", None, "m1#c@y.com"),
    ]
    assert rows[0].occurred_at is None and rows[0].subject == "(no subject)"


def test_the_address_parser_runs_once_per_message(spark):
    plan = messages.message_participants(spark.createDataFrame([mail({"From": "a@b.c"})], schemas.MESSAGES), own(spark))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [message_addresses") == 1


def test_change_log_collapses(spark):
    rows = [("t", "added", "m1", "5", 1), ("t", "added", "m2", "6", 2), ("t", "added", "m1", "7", 3), ("t", "deleted", "m1", "10", 4), ("u", "added", "m1", None, 5)]
    ids, newest = messages.collapse_changes(spark.createDataFrame(rows, schemas.CHANGES))
    assert sorted(tuple(r) for r in ids.collect()) == [("t", "added", "m1", 1), ("t", "added", "m2", 2), ("t", "deleted", "m1", 4), ("u", "added", "m1", 5)]
    assert {r.tenant_id: r.cursor for r in newest.collect()} == {"t": 10, "u": None}


def test_load_cap(spark):
    df = spark.range(9).select(F.col("id"), (-F.col("id")).alias("p"))
    assert [r.id for r in messages.first_listed(df, "p", 3).collect()] == [8, 7, 6]
    assert messages.first_listed(df, "p").count() == 9


def test_calendar_skips_owner_rooms_and_repeats(spark):
    guests = [
        ("me@x.com", "Me", True, None), (" Ann@x.com ", "Ann", None, False), ("ann@X.com", "Again", False, None),
        ("room@x.com", "Room", None, True), (None, "Ghost", None, None), ("nobody", None, None, None),
    ]
    events = spark.createDataFrame(
        [
            ("t", "e1", "confirmed", None, (None, "2026-06-26"), guests),
            ("t", "e2", "cancelled", "x", None, guests),
            ("t", "e3", None, "Sync", ("1999-12-31T23:00:00Z", None), [("b@x.com", "", None, None)]),
        ],
        schemas.CALENDAR,
    )
    kept, gone = calendar.split_cancelled(events)
    rows = {r.external_id: r for r in calendar.event_participants(kept).collect()}
    assert len(rows) == 2
    assert rows["e1"].source_record_id == "e1#ann@x.com" and rows["e1"].text == "Meeting '(no title)' with Ann"
    assert str(rows["e1"].occurred_at) == "2026-06-26 00:00:00" and rows["e1"].interaction_type == "meeting"
    assert rows["e3"].text == "Meeting 'Sync' with b@x.com"
    assert [r.external_id for r in gone.collect()] == ["e2"]
    assert {r.id for r in calendar.full_window(events).collect()} == {"e1"}


def test_contacts(spark, tmp_path):
    (tmp_path / "page.json").write_text(
        '{"tenant_id":"t","resourceName":"people/1","names":[{"displayName":"Jane"},{"displayName":"J"}],'
        '"emailAddresses":[{"value":"a@x"},{"value":"b@x","metadata":{"primary":true}}],"organizations":[{"name":"Acme","title":"CEO"}]}\n'
        '{"tenant_id":"t","resourceName":"people/2","emailAddresses":[{"value":"c@x"}]}\n'
        '{"tenant_id":"t","resourceName":"people/3","organizations":[{"name":"Acme"}]}\n'
    )
    rows = {r.source_record_id: r for r in contacts.contact_records(contacts.read_contacts(spark, str(tmp_path))).collect()}
    assert set(rows) == {"people/1", "people/2"}
    one = rows["people/1"]
    assert (one.display_name, one.primary_email, one.company, one.title, one.text) == ("Jane", "b@x", "Acme", "CEO", "Jane — CEO — Acme")
    assert rows["people/2"].text == "c@x"
    assert '"emailAddresses":[{"value":"a@x"}' in one.raw


CSV = (
    "Notes:\n\"When exporting, some fields\nmay be blank\"\n\n"
    "First Name,Last Name,Email Address,Company,Position,Connected On\n"
    "Jane,Doe,,Acme Inc,CEO,01 Jan 2024\n"
    "Bob,Smith, bob@x.com ,\"Globex, Ltd\",,02 Jan 2024\n"
    ",,,Nameless,,\n\n"
)


def test_connections_csv(spark):
    exports = spark.createDataFrame([("t", "f", CSV), ("t", "g", "no header\nhere"), ("t", "h", None)], "tenant_id STRING, file STRING, content STRING")
    first = sorted(connections.connection_records(exports).collect(), key=lambda r: r.display_name)
    assert [(r.display_name, r.primary_email, r.company, r.title) for r in first] == [
        ("Bob Smith", "bob@x.com", "Globex, Ltd", None), ("Jane Doe", None, "Acme Inc", "CEO"),
    ]
    assert [r.source_record_id for r in first] == [r.source_record_id for r in sorted(connections.connection_records(exports).collect(), key=lambda r: r.display_name)]
    assert first[1].text == "Jane Doe — CEO — Acme Inc"


def test_export_files_are_decoded(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + "First Name,Last Name\nJosé,X\n".encode())
    (tmp_path / "b.csv").write_bytes("First Name,Last Name\nJosé,Y\n".encode("latin-1"))
    exports = connections.read_exports(spark, str(tmp_path), "t")
    assert {r.display_name for r in connections.connection_records(exports).collect()} == {"José X", "José Y"}


def test_failed_rows_leave_only_ids_and_a_reason(spark):
    rows = [
        ("t", "contacts", None, "SECRET name", None, None, None, "SECRET", "{}"),
        ("t", "contacts", "r2", "SECRET name", None, None, None, "SECRET", "not json"),
        ("t", "contacts", "r3", "fine", None, None, None, "fine", "{}"),
    ]
    good, bad = deadletter.split_failed(deadletter.validate(spark.createDataFrame(rows, schemas.RECORD)), "record_error", "upsert")
    assert [r.source_record_id for r in good.collect()] == ["r3"]
    errors = bad.collect()
    assert bad.columns == deadletter.ERROR_COLUMNS
    assert {(e.source_record_id, e.stage, e.reason) for e in errors} == {
        (None, "upsert", "IntegrityError: missing source_record_id"), ("r2", "upsert", "DataError: raw data is not JSON"),
    }
    assert "SECRET" not in str(errors)


def test_tenants_are_kept_apart(spark):
    people = spark.createDataFrame([("1", "a", "x@a"), ("2", "b", "x@b")], "id STRING, tenant_id STRING, primary_email STRING")
    assert [r.id for r in governance.tenant_view(people, "a").collect()] == ["1"]
    assert governance.tenant_view(people, "a").where("primary_email = 'x@b'").count() == 0
    for unset in (None, ""):
        with pytest.raises(PermissionError):
            governance.tenant_view(people, unset)
        with pytest.raises(PermissionError):
            governance.check_tenant_write(people, unset)
    assert governance.check_tenant_write(people.where("tenant_id = 'a'"), "a").count() == 1
    with pytest.raises(PySparkException):
        governance.check_tenant_write(people, "a").collect()


def test_small_exports_are_read_by_all_tasks(spark):
    content = "First Name,Last Name,Email Address\nAnn,Lee,ann@x.example\nBo,Ray,\n"
    exports = spark.createDataFrame([("t", f"f{i}", content) for i in range(60)], "tenant_id string, file string, content string").coalesce(1)
    rows = connections.export_rows(exports)
    assert rows.rdd.getNumPartitions() >= 4
    assert rows.count() == 120 and rows.where("line = 1 and `first name` = 'Bo'").select("file").distinct().count() == 60
