from phaseloom.llm import toxicity


def test_a_stock_phrase_tells(documents, labels):
    """Before, a word that always follows the same word counted once, however many documents held it."""
    rows = [(i, f"plain w{i % 9} silly zzquarg w{i % 7}" if i % 4 == 0 else f"plain w{i % 9} silly w{i % 7}") for i in range(800)]
    asked = [(9000, "plain w1 silly zzquarg w2"), (9001, "plain w1 silly w2")]
    found = toxicity.toxicity(documents(rows + asked), labels([(i, None, int(i % 4 == 0)) for i in range(800)]))
    scores = {r.doc_id: r.score for r in found.filter("doc_id >= 9000").collect()}
    assert scores[9000] > 0.9 and scores[9001] < 0.1


def test_moderate_words_add_up(documents, labels):
    """Words that are only somewhat likelier in toxic texts decide together, in texts made like those that were learnt."""

    def text(i, toxic):
        return " ".join(f"{'rude' if (i * 7 + k * 13) % 10 < (7 if toxic else 3) else 'nice'}{k % 5} w{(i + k) % 11}" for k in range(20))

    rows = [(i, text(i, i % 2)) for i in range(800)]
    asked = [(9000 + k, " ".join(f"{name}{k % 5} w{(3 + k) % 11}" for k in range(20))) for k, name in enumerate(("rude", "nice"))]
    found = {r.doc_id: r for r in toxicity.toxicity(documents(rows + asked), labels([(i, None, i % 2) for i in range(800)])).filter("doc_id >= 9000").collect()}
    assert found[9000].mean_ratio > 0.1 and found[9001].mean_ratio < -0.1
    assert found[9000].score > 0.9 and found[9001].score < 0.1
