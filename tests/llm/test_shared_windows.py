"""Items that share windows: what the automaton holds grows with the items."""

import random
import time

from loomspark.llm.decontaminate import SuffixAutomaton


def plain(items, words, window):
    hit, found = set(), set()
    for name, own in items:
        size = min(window, len(own))
        for k in range(len(own) - size + 1):
            for at in range(len(words) - size + 1):
                if size and words[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(name)
    return hit, found


def test_a_shared_ending_is_held_once():
    draw = random.Random(1)
    ending = [b"e%d" % i for i in range(12)]
    items = [(str(n), [b"w%d" % draw.randrange(10**6) for _ in range(20)] + ending) for n in range(5000)]
    began = time.monotonic()
    automaton = SuffixAutomaton(items, 10)
    took = time.monotonic() - began
    entries = sum(len(names) for own in automaton.ends.values() for _, names in own)
    assert entries <= 23 * 5000 and took < 10
    runs, found = automaton.scan([b"x", *ending, b"y"])
    assert runs == [[1, 13]] and len(found) == 5000


def test_windows_of_all_sizes_on_one_way():
    """Short items that end others: each is found through the suffix links, and only where it fits."""
    draw = random.Random(2)
    for seed in range(60):
        letters = [bytes([97 + draw.randrange(2 + seed % 3)]) for _ in range(400)]
        items = [(str(n), letters[(a := draw.randrange(390)) : a + draw.choice([0, 1, 2, 3, 4, 5, 6, 9])]) for n in range(12)]
        words = [bytes([97 + draw.randrange(2 + seed % 3)]) for _ in range(60)]
        runs, found = SuffixAutomaton(items, 4).scan(words)
        hit, names = plain(items, words, 4)
        assert {i for a, b in runs for i in range(a, b)} == hit and found == names
        assert all(x[1] < y[0] for x, y in zip(runs, runs[1:], strict=False))


def test_words_of_a_rule_have_hashes_of_their_own():
    """Thue-Morse words and their complements, which polynomials modulo a power of two do not tell apart."""
    from loomspark.llm.shingles import shingle_sets

    word = "a"
    for _ in range(13):
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        one, two = shingle_sets([word.encode(), other.encode()])
        assert one.tolist() != two.tolist()
    words = [f"{'x' * i}y{'x' * (40 - i)}".encode() for i in range(41)]
    assert len({s.tolist()[0] for s in shingle_sets(words)}) == 41
    same = list(shingle_sets([b"One two  three four five", b"x y\none TWO three four five", b"one two three four five"]))
    assert same[0].tolist() == same[2].tolist() and same[0][0] in same[1]
