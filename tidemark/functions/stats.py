"""Statistics of arrays and the formulas of audio features, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key profiles of Krumhansl and Schmuckler, and the names of pitches.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std(v: Column) -> Column:
    """Population standard deviation."""
    m = mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m)) / F.size(v))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def entropy(v: Column) -> Column:
    """Shannon entropy, in bits, of weights made to sum to 1; weights of 0 add nothing."""
    s = total(v)
    return F.aggregate(v, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / s * F.log2(x / s)).otherwise(0.0))


def percentile(v: Column, q: float) -> Column:
    """Percentile of an array, interpolated."""
    s, at = F.array_sort(v), (F.size(v) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(v) - 1))
    return a + (b - a) * (at - low)


def mode(v: Column) -> Column:
    """Most frequent value of an array, the least of equals."""
    counts = F.transform(F.array_sort(F.array_distinct(v)), lambda x: F.struct((-F.size(F.filter(v, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_min(counts)["x"]


def diff(v: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda b, a: b - a)


def pearson(a: Column, b: Column) -> Column:
    def of(m: Column) -> Column:
        pairs = F.zip_with(a, b, lambda x, y: F.struct((x - m["a"]).alias("x"), (y - m["b"]).alias("y")))
        start = F.struct(*[F.lit(0.0).alias(c) for c in ("xy", "xx", "yy")])
        step = lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"))
        return F.aggregate(pairs, start, step, lambda s: s["xy"] / F.sqrt(s["xx"] * s["yy"]))

    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), of)


def lagged(v: Column, lag: int) -> Column:
    """Correlation of an array with itself ``lag`` places on."""
    n = F.size(v) - lag
    return F.when(n > 1, pearson(F.slice(v, 1, F.greatest(n, F.lit(1))), F.slice(v, lag + 1, F.greatest(n, F.lit(1)))))


def key_scores(chroma: Column) -> Column:
    """Correlations of a 12-part chroma with the 24 rotated profiles, best first, as (r, key, mode)."""
    scores = []
    for shift in range(12):
        turned = F.concat(F.slice(chroma, shift + 1, 12 - shift), F.slice(chroma, 1, shift)) if shift else chroma
        for m, profile in ((1, MAJOR), (0, MINOR)):
            r = pearson(turned, F.array(*[F.lit(x) for x in profile]))
            scores.append(F.struct(r.alias("r"), F.lit(shift).alias("key"), F.lit(m).alias("mode")))
    return F.reverse(F.array_sort(F.array(*scores)))


def key_of(chroma: Column) -> Column:
    """Struct of key, mode and two confidences: of the margin to the second best, and relative to the best."""

    def of(s: Column) -> Column:
        best, second = s[0]["r"], s[1]["r"]
        return F.struct(s[0]["key"].alias("key"), s[0]["mode"].alias("mode"), best.alias("r"), clip((best - second) * 5 + 0.3).alias("confidence"), clip((best - second) / (F.abs(best) + 1e-12) + best).alias("relative_confidence"))

    return let(key_scores(chroma), of)


def chord_templates() -> list[tuple[str, list[float]]]:
    """24 triads as unit vectors: for each root, major then minor."""
    out = []
    for root in range(12):
        for suffix, steps in (("", (0, 4, 7)), ("m", (0, 3, 7))):
            v = [0.0] * 12
            for s in steps:
                v[(root + s) % 12] = 1 / math.sqrt(3)
            out.append((PITCHES[root] + suffix, v))
    return out


def chord_of(chroma: Column) -> Column:
    """Struct of chord and confidence: the template with the greatest product with the scaled chroma, the first of equals."""
    names = F.array(*[F.lit(name) for name, _ in chord_templates()])

    def scores(c: Column) -> Column:
        out = []
        for k, (_, t) in enumerate(chord_templates()):
            on = [i for i, x in enumerate(t) if x]
            s = sum((F.get(c, F.lit(i)) for i in on[1:]), F.get(c, F.lit(on[0]))) / math.sqrt(3)
            out.append(F.struct(s.alias("s"), F.lit(-k).alias("k")))
        return F.array_max(F.array(*out))

    norm = F.sqrt(F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return let(let(chroma, scores), lambda best: F.struct(F.get(names, -best["k"]).alias("chord"), (best["s"] / norm).alias("confidence")))


# ---- feature formulas


def amplitude_db(x: Column) -> Column:
    return 20 * F.log10(x + 1e-12)


def midi(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440)


def gated_loudness(rms: Column) -> Column:
    """Mean level of the frames within 40 dB of the loudest."""
    db = F.transform(rms, amplitude_db)
    top = F.array_max(db)
    return mean(F.filter(db, lambda x: x > top - 40))


def lufs(rms: Column) -> Column:
    """Loudness of the frames above 3 in 100 of the greatest."""
    gate = F.array_max(rms) * 0.03
    loud = F.filter(rms, lambda x: x > gate)
    used = F.when(F.size(loud) > 0, loud).otherwise(rms)
    return amplitude_db(F.sqrt(mean(F.transform(used, lambda x: x * x)))) - 0.691


def energy(rms: Column, flux: Column, onset_rate: Column) -> Column:
    return 0.5 * F.tanh(rms * 8) + 0.3 * F.tanh(flux * 2) + 0.2 * F.tanh(onset_rate / 4)


def regularity(beats: Column) -> Column:
    """1 less the relative spread of the times between beats."""
    d = diff(beats)
    return 1 - clip(std(d) / (mean(d) + 1e-8))


def danceability(beats: Column, tempo: Column, pulse: Column) -> Column:
    score = 0.45 * regularity(beats) + 0.3 * F.exp(-F.pow((tempo - 115) / 45, F.lit(2))) + 0.25 * pulse
    return F.when(F.size(beats) < 8, 0.2).otherwise(score)


def acousticness(rolloff: Column, centroid: Column, flatness: Column, nyquist: float) -> Column:
    return 0.4 * (1 - clip(rolloff / nyquist)) + 0.4 * (1 - clip(centroid / 4000)) + 0.2 * (1 - clip(flatness * 10))


def speechiness(zcr_std: Column, syllabic_share: Column, flatness: Column) -> Column:
    return clip(0.4 * clip(zcr_std * 20) + 0.4 * syllabic_share + 0.2 * flatness * 5) * 0.66


def instrumentalness(vocal_ratio: Column) -> Column:
    return clip(1.6 - vocal_ratio)


def valence(mode_: Column, centroid: Column, energy_: Column) -> Column:
    return 0.35 * mode_ + 0.35 * clip(centroid / 3500) + 0.3 * energy_


def liveness(rms: Column, flatness: Column) -> Column:
    """Flatness of the quietest quarter of the frames; 0.1 if those are under five."""
    low = percentile(rms, 0.25)
    pairs = F.zip_with(rms, flatness, lambda r, f: F.struct(r.alias("r"), f.alias("f")))
    quiet = F.filter(pairs, lambda x: x["r"] < low)
    return F.when(F.size(quiet) < 5, 0.1).otherwise(clip(mean(F.transform(quiet, lambda x: x["f"])) * 8) * 0.8)


def time_signature(strengths: Column) -> Column:
    """Beats in a bar, of 3, 4, 5 and 7: where the mean strengths of a bar's places differ most. 4 for under 16 beats."""
    scores = []
    for sig in (3, 4, 5, 7):
        bars = F.floor(F.size(strengths) / sig).cast("int")
        place = lambda k, sig=sig, bars=bars: mean(F.transform(F.sequence(F.lit(0), F.greatest(bars - 1, F.lit(0))), lambda b: F.get(strengths, b * sig + k)))
        scores.append(F.when(F.size(strengths) >= sig * 4, F.struct(std(F.array(*[place(k) for k in range(sig)])).alias("s"), F.lit(-sig).alias("sig"))))
    best = F.array_max(F.array_compact(F.array(*scores)))
    return F.when(F.size(strengths) < 16, 4).otherwise(F.coalesce(-best["sig"], F.lit(4)))


def mood(rms: Column, tempo: Column, centroid: Column, mode_: Column, beat_regularity: Column) -> Column:
    """Struct of ten scores from signal statistics; mode is 1, 0 or null."""
    e = clip(rms * 12)
    arousal = clip(0.5 * e + 0.3 * F.least(tempo / 180, F.lit(1.0)) + 0.2 * F.least(centroid / 5000, F.lit(1.0)))
    bright = F.least(centroid / 4500, F.lit(1.0))
    v = clip(0.45 + 0.3 * (bright - 0.5) + F.when(mode_ == 1, 0.15).when(mode_ == 0, -0.15).otherwise(0.0))
    dance = clip(0.4 * beat_regularity + 0.3 * e + 0.3 * F.exp(-(tempo - 120) * (tempo - 120) / 2400))
    scores = {
        "valence": v, "arousal": arousal, "dominance": clip(0.5 * arousal + 0.5 * e), "danceability": dance, "energy": e, "positivity": v,
        "aggression": clip(e * (1 - v) * 1.5), "melancholy": clip((1 - v) * (1 - arousal) * 1.8), "tension": clip(arousal * (1 - v) * 1.6), "relaxation": clip((1 - arousal) * v * 1.8),
    }
    return F.struct(*[x.alias(k) for k, x in scores.items()])
