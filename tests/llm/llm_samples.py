def prose(rng, n, letters="abcdefghij"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return " ".join(out)
