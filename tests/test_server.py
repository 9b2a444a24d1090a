"""The editor server, rechecks, memory of answers and failed reads."""

import io

import pytest
from pyspark.sql import functions as F

from quillspark.operators import capture, lexicon, report
from quillspark.plans.engine import Engine, Memo
from quillspark.plans.policy import Policy, Settings
from quillspark.sources import files, resources
from quillspark.streaming import server, sessions


def framed(*messages):
    out = io.BytesIO()
    for m in messages:
        server.write_message(out, m)
    return io.BytesIO(out.getvalue())


def sent(target):
    stream, out = io.BytesIO(target.getvalue()), []
    while (m := server.read_message(stream)) is not None:
        out.append(m)
    return out


def doc(uri, version=1, text=None, language="plaintext"):
    return {"textDocument": {"uri": uri, "version": version, "languageId": language, "text": text}}


def bad_words(text, language, path):
    return [{"range": {"start": {"line": n, "character": k}, "end": {"line": n, "character": k + 3}}, "severity": 3, "message": "m"} for n, line in enumerate(text.split("\n")) for k in [line.find("teh")] if k >= 0]


def test_a_session_of_an_editor():
    uri, added, arrived = "file:///p/a.txt", [], []
    place = {"start": {"line": 1, "character": 2}, "end": {"line": 1, "character": 5}}
    messages = [
        {"id": 1, "method": "initialize", "params": {"initializationOptions": "broken"}}, {"method": "initialized"}, {"method": "textDocument/didOpen", "params": doc(uri, 1, "ok")},
        {"method": "textDocument/didChange", "params": {**doc(uri, 2), "contentChanges": [{"text": "x"}, {"text": "\n😀teh"}]}}, {"method": "textDocument/didChange", "params": {**doc("file:///q"), "contentChanges": [{"text": "teh"}]}},
        {"id": 2, "method": "textDocument/codeAction", "params": {**doc(uri), "context": {"diagnostics": [{"source": server.SOURCE, "range": place}, {"source": "other", "range": place}]}}},
        {"id": 3, "method": "workspace/executeCommand", "params": {"command": "add_word", "arguments": ["teh"]}}, {"id": 4, "method": "no/such"}, {"method": "textDocument/didSave", "params": {**doc(uri), "text": "fine"}},
        {"method": "textDocument/didClose", "params": doc(uri)}, {"id": 5, "method": "shutdown"}, {"method": "exit"},
    ]
    target = io.BytesIO()
    s = server.Server(framed(*messages), target, bad_words, lambda w: [w + str(k) for k in range(9)], lambda c, x: added.append((c, x)), lambda: bool(arrived))
    s.log.write("before")
    assert s.run() == 0
    out = sent(target)
    by_id = {m["id"]: m for m in out if "id" in m}
    assert by_id[1]["result"]["capabilities"]["executeCommandProvider"]["commands"] == list(server.COMMANDS) and by_id[4]["error"]["code"] == -32601
    titles = [a["title"] for a in by_id[2]["result"]]
    assert titles == [f"Replace with 'teh{k}'" for k in range(5)] + ["Add 'teh' to the project's words", "Add 'teh' to all projects' words", "Ignore this file"]
    assert added == [("add_word", "teh")] and [m for m in out if m.get("method") == "window/logMessage"][0]["params"]["message"] == "before"
    published = [(m["params"].get("version"), len(m["params"]["diagnostics"])) for m in out if m.get("method") == "textDocument/publishDiagnostics"]
    assert published == [(1, 0), (2, 1), (2, 1), (2, 0), (None, 0)]


def test_only_saves_are_checked_and_arrivals_check_all():
    arrived = iter([False, False, True, False])
    target = io.BytesIO()
    messages = [{"id": 1, "method": "initialize", "params": {"initializationOptions": {"checkWhileTyping": False}}}, {"method": "textDocument/didOpen", "params": doc("file:///a", 1, "teh")}, {"method": "initialized"}, {"method": "textDocument/didSave", "params": doc("file:///a")}]
    assert server.Server(framed(*messages), target, bad_words, list, print, lambda: next(arrived)).run() == 1
    assert [m["params"]["uri"] for m in sent(target) if "method" in m] == ["file:///a"] * 2


def test_the_log_keeps_the_last_lines():
    log, got = server.LogBuffer(3), []
    for k in range(5):
        log.write(str(k))
    log.attach(got.append)
    log.write("5")
    assert got == ["2", "3", "4", "5"]


def test_a_server_over_an_engine(spark, tmp_path):
    policy = Policy(tmp_path, everywhere=tmp_path / "global.toml")
    engine = Engine(spark, policy)
    engine.add_lexicon("base", lexicon.from_words(spark, ["the", "fine"], "base"), primary=True)
    uri, target = f"file://{tmp_path}/a.txt", io.BytesIO()
    messages = [{"method": "textDocument/didOpen", "params": doc(uri, 4, "the\nä teh")}, {"id": 1, "method": "workspace/executeCommand", "params": {"command": "add_word", "arguments": ["teh"]}}, {"id": 2, "method": "workspace/executeCommand", "params": {"command": "ignore_file", "arguments": [f"{tmp_path}/a.txt"]}}]
    s = server.of_engine(engine, policy, framed(*messages), target)
    s.run()
    published = [m["params"] for m in sent(target) if m.get("method") == "textDocument/publishDiagnostics"]
    assert published[0]["diagnostics"] == [{"range": {"start": {"line": 1, "character": 2}, "end": {"line": 1, "character": 5}}, "severity": 3, "message": "Possible spelling issue 'teh'.", "source": server.SOURCE}]
    assert [p["diagnostics"] for p in published[1:]] == [[], []] and s.suggest("teh") == ["the"]
    assert policy.snapshot.words == ("teh",) and policy.snapshot.ignore_paths == ("a.txt",)


def test_all_open_documents_are_checked_again(spark, tmp_path):
    """A document is published empty while no lexicon is there, and anew once one arrives, though nobody touched it."""
    schema = "uri string, version long, language_id string, text string, open boolean, saved boolean"
    known, shown = [], {}

    def find(docs):
        words = docs.select("uri", "version", F.explode(F.split("text", " ")).alias("word"))
        return words.where(F.lit(bool(known)) & (F.col("word") != "the"))

    def sink(docs, findings, batch):
        for r in docs.collect():
            shown[r.uri] = []
        for r in findings.collect():
            shown[r.uri].append((r.version, r.word))

    arrivals = iter([False, True, False])
    p = sessions.Published(find, sink, lambda: next(arrivals), f"file://{tmp_path}")
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    p(batch(("a", 1, "Text", "teh the", True, False), ("b", 1, "Text", "the", True, False)), 0)
    assert shown == {"a": [], "b": []}
    known.append("lexicon")
    p(batch(("b", 2, "Text", "wrd", True, False)), 1)
    assert shown == {"a": [(1, "teh")], "b": [(2, "wrd")]}
    p(batch(("a", 1, None, None, False, False)), 2)
    assert shown == {"a": [], "b": [(2, "wrd")]}
    quiet, checked = [], []
    p = sessions.Published(lambda d: find(d), lambda docs, f, n: checked.append(sorted(r.uri for r in docs.collect())), typing=False)
    p(batch(("a", 1, "Text", "x", True, False), ("b", 1, "Text", "y", True, True), ("c", 1, None, None, False, False)), 0)
    assert checked == [["b", "c"]] and not quiet


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good").write_text("ä")
    (tmp_path / "bytes").write_bytes(b"\xff")
    paths = [str(tmp_path / x) for x in ("good", "bytes", "gone")]
    got = {r.path: (r.text, r.state) for r in files.read_files(spark, paths, str(tmp_path)).collect()}
    assert got == {"good": ("ä", "checked"), "bytes": (None, "checked"), "gone": (None, "failed")}
    one = spark.createDataFrame([], "path string, word string")
    assert report.summary(files.read_files(spark, paths), one).first().status == 2


def test_german_readings_in_suggestions(spark):
    e = Engine(spark, Settings(dictionaries=("de",)))
    e.add_lexicon("de", lexicon.from_words(spark, ["Bücher", "Büchse", "Haus"], "de"))
    asked = ["buecher", "Buechr", "Hauss"]
    got = {r.word: r.suggestions for r in e.suggestions(spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
    assert "buecher" not in got and got["Buechr"][0] == "Bücher" and "Haus" in got["Hauss"]


def test_answers_are_remembered_until_dictionaries_change(spark):
    e = Engine(spark, Settings())
    e.add_lexicon("d", lexicon.from_words(spark, ["hello"], "d"), primary=True)
    assert e.suggested(["helo", "zzzzzzz"]) == {"helo": ["hello"], "zzzzzzz": []}
    assert "helo" in e.memo and "zzzzzzz" not in e.memo and e.suggested(["helo"]) == {"helo": ["hello"]}
    epoch = e.epoch
    e.invalidate("d")
    assert "helo" not in e.memo and not e.add_lexicon("d", lexicon.from_words(spark, ["old"], "d"), epoch=epoch) and "d" not in e.lexicons
    assert e.add_lexicon("d", lexicon.from_words(spark, ["new"], "d"), epoch=e.epoch)
    memo = Memo()
    memo.MOST = 2
    for w in ("a", "b"):
        memo.put(w, [w])
    memo.get("a")
    memo.put("c", ["c"])
    assert "a" in memo and "b" not in memo and "c" in memo


def test_the_list_that_ships(spark):
    e = Engine(spark, Settings(), embedded=True)
    assert e.ensure("builtin") == "new" and not e.has_primary()
    words = {r.word for r in e.lexicons["builtin"].collect()}
    assert {"async", "json", "substring", "isinstance"} <= words and all(w == w.lower() for w in words)


def test_prefetching_goes_on_until_stopped():
    calls, arrived, answers = [], [], iter([False, True, None])
    states = {"pair": iter([resources.ResourceError("later"), "new", "fresh"]), "gone": iter([resources.ResourceError("404", True)])}

    def ensure(name):
        calls.append(name)
        out = next(states[name])
        if isinstance(out, Exception):
            raise out
        return out

    waits = []
    passes = resources.keep_prefetching(lambda: ["pair", "gone"], ensure, resources.BackOff(), lambda s: (waits.append(s), next(answers))[1], lambda: arrived.append(1), lambda: 100.0)
    assert passes == 3 and calls == ["pair", "gone", "pair"] and waits == [30, 30, resources.IDLE_WAIT] and arrived == [1]


def test_pairs_are_put_in_place_together(tmp_path, monkeypatch):
    class Wire:
        def get(self, url, since):
            asked.append((url, since))
            return resources.Response(200, f"{url} {len(asked)}".encode(), "Tue")

    asked, now = [], [0.0]
    cache = resources.Cache(tmp_path, Wire(), lambda: now[0])
    assert cache.pair("http://x/d.aff", "http://x/d.dic") == "new"
    now[0] += resources.FRESH_SECONDS + 1
    cache.fetch("http://x/d.aff")
    assert asked[-1] == ("http://x/d.aff", "Tue")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    write, n = resources.Path.write_bytes, [0]

    def fails(self, data):
        n[0] += 1
        if n[0] == 2:
            raise OSError("full")
        return write(self, data)

    now[0] += resources.FRESH_SECONDS + 1
    monkeypatch.setattr(resources.Path, "write_bytes", fails)
    with pytest.raises(OSError):
        cache.pair("http://x/d.aff", "http://x/d.dic")
    after = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert {k: v for k, v in after.items() if k != "index.json"} == {k: v for k, v in before.items() if k != "index.json"}


def test_the_last_action_ignores_the_file(spark):
    places = spark.createDataFrame([("a.md", "teh")], "path string, word string")
    hints = spark.createDataFrame([("teh", ["the"])], "word string, suggestions array<string>")
    assert [tuple(a) for a in report.quick_fixes(places, hints, path="path").first().actions] == [("replace", "the"), ("add_to_project", "teh"), ("add_to_global", "teh"), ("ignore_file", "a.md")]


def test_regions_have_no_greatest_depth():
    text = "word"
    for k in range(12):
        fence = "`" * (3 + k)
        text = f"{fence}markdown\n{text}\n{fence}"
    assert [(t, x, text.encode()[a:b]) for t, x, a, b in capture.regions(text, "Markdown")] == [("string", "Markdown", b"word")]
    lines = capture.outline("<p title='a'>b<script>let x = 'y'</script></p>", "HTML")
    assert any("Typescript" in x for x in lines) and all("[" in x for x in lines)


def test_lines_and_columns_of_many_places():
    import numpy as np

    text = "aé\n😀b\r\n\nend ü"
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    for utf16 in (False, True):
        lines, columns = report.lines_and_columns(text, np.array(at), utf16)
        for k, (line, column) in enumerate(zip(lines, columns)):
            head = text[:k]
            tail = head[head.rfind("\n") + 1 :]
            assert (line, column) == (head.count("\n"), len(tail.encode("utf-16-le")) // 2 if utf16 else len(tail))
