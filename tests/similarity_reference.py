"""Plain Python similarity, the yardstick of the column expressions."""


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def token_set_of(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100.0
    head = " ".join(sorted(shared))
    texts = [" ".join(x for x in (head, " ".join(sorted(rest))) if x) for rest in (left - right, right - left)]
    rests = [" ".join(sorted(rest)) for rest in (left - right, right - left)]
    edits = sum(map(len, rests)) - 2 * common_subsequence(*rests)
    best = 100.0 - 100.0 * edits / sum(map(len, texts))
    for text in texts if shared else ():
        best = max(best, 100.0 - 100.0 * (len(text) - len(head)) / (len(head) + len(text)))
    return best
