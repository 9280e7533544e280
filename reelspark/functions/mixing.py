"""Channel matrices: stereo downmixes and speaker routing, as rows of weights per output."""
from __future__ import annotations

import math

from .tables import LAYOUT_SPEAKERS, OUTPUT_LAYOUTS

HALF_POWER = math.sqrt(0.5)
# 5.1 to stereo as (direct, center, lfe, surround, opposite surround)
FIVE_POINT_ONE = {
    "ac4": (1.0, HALF_POWER, 0.0, HALF_POWER, 0.0),
    "standard-loro": (1.0, HALF_POWER, 0.0, HALF_POWER, 0.0),
    "dave750": (0.707, 0.5, 0.5, 0.707, 0.0),
    "night-mode-dialogue": (0.3, 1.0, 0.0, 0.3, 0.0),
    "peak-normalized-loro": tuple(w / (1 + 2 * HALF_POWER) for w in (1.0, HALF_POWER, 0.0, HALF_POWER, 0.0)),
    "rfc7845": (0.529067, 0.374107, 0.374107, 0.458186, 0.264534),
}
# 7.1 to stereo as (direct, center, lfe, side, back, opposite side, opposite back)
SEVEN_POINT_ONE = {
    "ac4": (1.0, HALF_POWER, 0.0, 0.5, 0.5, 0.0, 0.0),
    "standard-loro": (1.0, HALF_POWER, 0.0, HALF_POWER, HALF_POWER, 0.0, 0.0),
    "dave750": (0.707, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0),
    "night-mode-dialogue": (0.3, 1.0, 0.0, 0.3 * HALF_POWER, 0.3 * HALF_POWER, 0.0, 0.0),
    "peak-normalized-loro": tuple(w / (1 + 3 * HALF_POWER) for w in (1.0, HALF_POWER, 0.0, HALF_POWER, HALF_POWER, 0.0, 0.0)),
    "rfc7845": (0.388631, 0.274804, 0.274804, 0.336565, 0.336565, 0.194316, 0.194316),
}
SIX_POINT_ONE_DIRECT = 1 / (1 + 3 / math.sqrt(2))
# Where a speaker the output lacks folds to
FOLDS = {
    "back-left": "side-left", "back-right": "side-right", "side-left": "back-left", "side-right": "back-right",
    "top-back-left": "back-left", "top-back-right": "back-right", "top-front-left": "front-left", "top-front-right": "front-right",
}


def targets(speaker: str, output: list[str]) -> list[str]:
    """The output speakers a decoded channel feeds."""
    if speaker in output:
        return [speaker]
    if speaker == "back-center":
        return targets("back-left", output) + targets("back-right", output)
    fold = FOLDS.get(speaker)
    if fold is None:
        return []
    if speaker.startswith("top-"):
        return targets(fold, output)
    return [fold] if fold in output else []


def routing(layout: str, output: str) -> tuple[list[list[float]], bool]:
    """Weights (outputs x inputs) into an output layout, and whether some output sums channels.

    A split channel takes sqrt(1/2) on each side, and each of n whole channels in one speaker 1/sqrt(n).
    """
    speakers, out = LAYOUT_SPEAKERS[layout], LAYOUT_SPEAKERS[OUTPUT_LAYOUTS[output]]
    fed = [targets(speaker, out) for speaker in speakers]
    whole = {name: sum(route == [name] for route in fed) for name in out}
    weights = [[0.0] * len(speakers) for _ in out]
    for column, route in enumerate(fed):
        for name in route:
            weights[out.index(name)][column] = HALF_POWER if len(route) > 1 else math.sqrt(1 / whole[name])
    return weights, any(sum(name in route for route in fed) > 1 for name in out)


def _stereo(speaker: str, algorithm: str, floor: str) -> tuple[float, float, str]:
    """Left and right weight of a 5.1 or 7.1 speaker, and the user level that scales it."""
    if floor == "5.1":
        direct, center, lfe, side, opposite_side = FIVE_POINT_ONE[algorithm]
        back, opposite_back = side, opposite_side
    else:
        direct, center, lfe, side, back, opposite_side, opposite_back = SEVEN_POINT_ONE[algorithm]
    if speaker == "front-center":
        return center, center, "center"
    if speaker == "low-frequency-effects":
        return lfe, lfe, "none"
    near, far, level = {
        "front": (direct, 0.0, "none"), "side": (side, opposite_side, "surround"), "back": (back, opposite_back, "surround"),
    }[speaker.split("-")[0]]
    return (near, far, level) if speaker.endswith("left") else (far, near, level)


def downmix_weights(layout: str, algorithm: str) -> list[tuple[float, float, str]]:
    """Left weight, right weight and user level (none, center, surround) of each channel of a layout."""
    speakers = LAYOUT_SPEAKERS[layout]
    if layout == "mono":
        return [(1.0, 1.0, "fixed")]
    if layout == "stereo":
        return [(1.0, 0.0, "fixed"), (0.0, 1.0, "fixed")]
    if len(speakers) == 3:
        # The normalised matrices are normalised for six channels, so a three-channel bed renormalises its own weights
        renormalise = algorithm in ("peak-normalized-loro", "rfc7845")
        base = FIVE_POINT_ONE["standard-loro" if algorithm == "peak-normalized-loro" else algorithm]
        shared, level = {
            "front-center": (base[1], "center"), "low-frequency-effects": (base[2], "none"),
            "back-center": ((base[3] + base[4]) * HALF_POWER, "surround")}[speakers[2]]
        scale = 1 / (base[0] + shared) if renormalise else 1.0
        return [(base[0] * scale, 0.0, "none"), (0.0, base[0] * scale, "none"), (shared * scale, shared * scale, level)]
    if layout == "6.1":
        mixed = SIX_POINT_ONE_DIRECT * HALF_POWER
        plain = {"front-left": (SIX_POINT_ONE_DIRECT, 0.0, "none"), "front-right": (0.0, SIX_POINT_ONE_DIRECT, "none"),
                 "front-center": (mixed, mixed, "center"), "low-frequency-effects": (0.0, 0.0, "none"),
                 "back-center": (mixed, mixed, "surround"), "side-left": (mixed, 0.0, "surround"), "side-right": (0.0, mixed, "surround")}
        return [plain[speaker] for speaker in speakers]
    floor = "7.1" if layout.startswith("7.1") else "5.1"
    if layout in ("7.1", "5.1-side", "5.1-back"):
        return [_stereo(speaker, algorithm, floor) for speaker in speakers]
    # Other beds map to their floor by name first; all speakers a channel feeds share one user level
    weights, _ = routing(layout, floor)
    out = [_stereo(speaker, algorithm, floor) for speaker in LAYOUT_SPEAKERS[OUTPUT_LAYOUTS[floor]]]
    result = []
    for column in range(len(speakers)):
        fed = [(row[column], mix) for row, mix in zip(weights, out) if row[column]]
        result.append((sum(w * mix[0] for w, mix in fed), sum(w * mix[1] for w, mix in fed), fed[0][1][2]))
    return result
