import random
import zlib

from vivaspark.llm import toxicity as tx


def test_composition_equals_machines_one_after_the_other():
    parts = [tx.negation(), tx.reported_speech(), tx.target(), tx.threat()]
    g = tx.grammar()
    nxt, weight = g.dense()
    rng = random.Random(6)
    for _ in range(3000):
        labels = rng.choices(range(7), [4, 3, 2, 3, 2, 1, 1], k=rng.randrange(14))
        tape, total = labels, 0.0
        for m in parts:
            tape, w = m.run(tape)
            total += w
        roles, whole = g.run(labels)
        assert roles == tape and abs(whole - total) < 1e-9
        state = 0
        for x in labels:
            total -= weight[state][x]
            state = nxt[state][x]
        assert abs(total) < 1e-9


def test_roles_of_clauses():
    g = tx.grammar()
    run = lambda *labels: (g.run(list(labels))[0], round(g.run(list(labels))[1], 6))
    assert run(tx.INSULT) == ([tx.INSULT], 0)
    assert run(tx.TARGET, tx.OTHER, tx.INSULT) == ([tx.TARGET, tx.OTHER, tx.ATTACK], 0.4)
    assert run(tx.INSULT, tx.TARGET) == ([tx.INSULT, tx.ATTACK], 0.4)
    assert run(tx.NEGATION, tx.INSULT) == ([tx.NEGATION, tx.DENIED], -1.0)
    assert run(tx.NEGATION, tx.THREAT, tx.TARGET)[1] == -1.0
    assert run(tx.REPORT, *[tx.OTHER] * 9, tx.INSULT)[1] == -0.6
    assert run(tx.QUOTE, tx.INSULT, tx.QUOTE, tx.INSULT) == ([tx.QUOTE, tx.QUOTED, tx.QUOTE, tx.INSULT], -0.6)
    assert run(tx.THREAT, tx.OTHER, tx.TARGET) == ([tx.THREAT, tx.OTHER, tx.MENACE], tx.MENACE_WEIGHT)
    assert run(tx.TARGET, *[tx.OTHER] * 5, tx.INSULT)[1] == 0


def test_clauses_of_text():
    """Weights of matched clauses, worked out by hand, with a lexicon of one insult of weight 5."""
    reader = tx.Model({"idiot": 5.0}, [], [], []).reader()
    weights = lambda t: [round(x, 6) for x in reader.clauses(t)[0]]
    assert weights("You are an idiot.") == [5.4]
    assert weights("He said: you are an idiot.") == weights("he said you are an idiot") == [4.4]  # he and you are targets, quoted no attack
    assert weights("You are not an idiot! Idiot") == [4.0, 5.0]
    assert weights("I will kill you; you kill time") == [tx.MENACE_WEIGHT]
    assert weights("ich will dich t\u00f6ten, dich") == weights("je vais d\u00e9truire toi") == [tx.MENACE_WEIGHT]
    assert weights("nothing here") == []


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiounrst") for _ in range(6)) for _ in range(300)]
    texts, y = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                ws[rng.randrange(60)] = rng.choice(["grulk" + rng.choice(["a", "o", "im"]), "blorf"])
        texts.append(" ".join(ws) + ".")
        y.append(int(toxic))
    return texts, y


def test_learns_words_and_beginnings():
    model = tx.fit(*corpus())
    reader = model.reader()
    texts, y = corpus(seed=9)
    assert sum((reader.score(t) >= 0.7) == bool(v) for t, v in zip(texts, y)) >= 395
    assert "blorf" in model.lexicon and "grulk*" in model.lexicon
    assert reader.score("you blorf") > reader.score("he said blorf") > reader.score("not a blorf") - 1e-9
    assert reader.score(None) == reader.score("") == reader.score(" \n") < 0.3
    assert reader.score("blorf " * 5000) == reader.score("blorf " * 5000)


def test_no_labels_and_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "kill you all", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tx.train(docs, labels)
    got = tx.score(docs, model)
    assert got.count() == 4 and got.filter("score < 0 or score > 1").count() == 0
    assert tx.score(docs.limit(0), model).count() == 0
    assert tx.keep_clean(docs, model).columns == docs.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # 266 documents in the smaller table are too few to learn four languages from
    got = {r.doc_id: r for r in tx.op3_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in labels)
    assert sum(got[r.doc_id].predicted == r.toxic for r in labels) / len(labels) > 0.97
    clean = [r for r in labels if not r.toxic]
    assert sum(got[r.doc_id].predicted for r in clean) / len(clean) < 0.02
