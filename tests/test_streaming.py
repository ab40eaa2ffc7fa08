from tidemark.plans import catalogue

Q = catalogue.queries()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_streamed_replay_equals_batch(spark, sf):
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(Q["x4_wal_replay_stream"](spark, sf)) == key(Q["l1_replay_full"](spark, sf)) != []


def test_sessions_are_consumed_once(spark, sf):
    from tidemark.plans import views

    got = rows(Q["x2_session_stream"](spark, sf).select("key", "session_id", "feedback_id"))
    want, live = [], {}
    for e in views.events(spark, sf).orderBy("ts_ms", "event_id").collect():
        k = str(e.user_id)
        live[k] = [(t, i) for t, i in live.get(k, []) if e.ts_ms - t <= 1_800_000]
        if e.event_type == "view":
            live[k].append((e.ts_ms, e.event_id))
        elif e.event_type == "purchase" and live[k]:
            want.append((k, live[k].pop(0)[1], e.event_id))
    assert got == sorted(want)
