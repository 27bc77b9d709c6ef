import pytest

from quarrystone.llm import stuffing

PROSE = "The parser gives up on a lazy node and stores one chunk for the whole file. When a record arrives, the indexer keeps the edge and drops the header of it. I could not reproduce this with the newer workers, so we moved the frame out of the bundle because it kept growing. "
STUFFED = {
    "keywords": "cloud build cloud build cheap hosting cloud build " * 8,
    "commas": "log viewer, api client, log viewer, api client, api client, log viewer, " * 6,
    "shop": "\n".join(f"SKU {k}12 fast linter {x} {k}4.{k} sale" for k in range(1, 9) for x in ("S", "XL")),
    "links": "\n".join(f'<a href="https://x{k}.example/a">site {w}</a>' for k, w in enumerate("abcdefghijklm")),
    "markdown links": "<br>".join(f"- [page {w}](https://{w}.example/x)" for w in "abcdefghijklmn"),
    "addresses": "\n".join(f"https://h{k}.example/p" for k in range(12)),
    "tags": " ".join(["#cloudbuild", "#mergebot", "#node"] * 12),
    "spaced": "c l o u d b u i l d cloud build! m e r g e b o t merge bot* " * 6,
    "buy": "Looking for cloud build? cloud build is here, cloud build repo mirror. Buy repo mirror cloud build online repo mirror. Best repo mirror for cloud build. " * 5,
    "around": PROSE[:75] + "\n\n" + "merge bot | diff tool | merge bot | diff tool | merge bot | " * 8,
    "french": "index rapide, meilleur outil, index rapide gratis. Top graphe de symboles index rapide graphe de symboles. " * 6,
}
FINE = {
    "prose": PROSE * 3,
    "changelog": "\n".join(f"- The {w} splits every node before the queue is written, so plan for it. [#12{k}](https://tracker.example/{k})" for k, w in enumerate("abcdefgh")),
    "explained links": "\n".join(f"- [tool {w}](https://{w}.example): this is the one that we use for the nightly runs of our indexer, because it is fast." for w in "abcdef"),
    "see also": PROSE * 2 + "\n\nSee also:\n- https://a.example/x\n- https://b.example/y",
    "code": "\n".join(f"def load_{w}(arg):\n    width = arg.size\n    return width + {k}" for k, w in enumerate("abcdefgh")),
    "log": "\n".join(f"12:0{k % 9} WARN load_item took {k}3 ms" for k in range(12)),
    "note": "queue: stream stable widget",
    "badges": "# kit\n\n[![a](https://b.example/a.png)](https://ci.example/a)\n[![b](https://b.example/b.png)](https://ci.example/b)\n\n" + PROSE,
    "keyword in front": ("Fast linter. " + PROSE + "\n\n") * 3,
}


@pytest.fixture(scope="module")
def found(spark):
    texts = {**STUFFED, **FINE}
    rows = [(k, t, "fr" if n == "french" else "EN " if n == "tags" else "en") for k, (n, t) in enumerate(texts.items())]
    rows += [(100 + k, PROSE * (1 + k % 3), "en") for k in range(30)] + [(200 + k, "Le parseur relit chaque fichier quand la table manque, et nous avons déplacé le cadre car il devenait trop grand. " * 3, "fr") for k in range(30)]
    rows += [(300, None, "en"), (301, "", "en"), (302, " \n", None), (None, STUFFED["commas"], "en"), (303, STUFFED["commas"], None), (304, STUFFED["links"], "xx"), (0, STUFFED["keywords"], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return list(texts), {r["doc_id"] for r in stuffing.stuffed_pages(df).collect()}


@pytest.mark.parametrize("name", list(STUFFED))
def test_stuffed(found, name):
    assert found[0].index(name) in found[1]


@pytest.mark.parametrize("name", list(FINE))
def test_fine(found, name):
    assert found[0].index(name) not in found[1]


def test_other_rows(found):
    assert {303, 304} <= found[1] and not {300, 301, 302, None} & found[1] and not any(100 <= k < 300 for k in found[1] if k)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "merge bot, " * 30_000, "en")], "doc_id long, text string, lang string")
    assert stuffing.stuffed_pages(df.where("false")).count() == 0
    assert stuffing.page_features(df).count() == 1


ITALIAN = (
    "Il parser rilegge ogni file quando la tabella manca e noi abbiamo spostato il riquadro perché diventava troppo grande. "
    "Per favore non cancellare il nodo finché la verifica è aperta, altrimenti la ricerca si ferma dopo pochi secondi. "
    "Ogni volta che il servizio scrive una riga, il registro della coda viene controllato e poi copiato in un altro archivio. "
)


def test_a_language_without_a_list_has_function_words_of_its_own(spark):
    parts = [x + ". " for x in ITALIAN.split(". ") if x]
    prose = [(k, (parts[k % 3] + parts[(k + 1) % 3]) * (3 if k % 3 == 0 else 1), "it") for k in range(31)]
    stuffed = [(100, "cloud build economico, hosting veloce, cloud build, hosting veloce, " * 8, "it"), (101, STUFFED["links"], "it-IT")]
    df = spark.createDataFrame(prose + stuffed, "doc_id long, text string, lang string")
    words = stuffing.function_words(df)
    assert {"il", "la", "e"} <= words["it"] and "hosting" not in words["it"] and set(words) == {"it"}
    assert {r["doc_id"] for r in stuffing.stuffed_pages(df).collect()} == {100, 101}


def test_features_do_not_depend_on_the_batch():
    texts = [*STUFFED.values(), *FINE.values(), "x", "Uno due tre."]
    assert stuffing.features(texts) == [stuffing.features([t])[0] for t in texts]


def test_limits_of_few_pages_are_near_those_of_all(spark):
    rows = [(k, PROSE, "en") for k in range(40)] + [(99, "palabra " * 30, "es")]
    limits = {r["lang"]: r for r in stuffing.calibrated(stuffing.page_features(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert abs(limits["es"]["low_function"] - limits["en"]["low_function"]) < 0.05 and limits["es"]["high_word"] <= 0.3
