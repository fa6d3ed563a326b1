"""Expression text to column name, antenna names and bit helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from firn.functions.compare import col

# Replacements applied in this order.
REPLACEMENTS = [
    ("sum.", ""), ("()", ""), ("(", "_"), (")", "_"), ("[]", ""), ("[", "_"), ("]", "_"),
    (".", "_"), ("TMath::", ""), ("FFTtools::", ""), (",", "_"), ("$", ""),
    ("/", "_over_"), ("+", "_plus_"), ("-", "_minus_"), ("*", "_times_"),
    ("==", "_eq_"), (">=", "_ge_"), ("<=", "_le_"), (">", "_gt_"), ("<", "_lt_"),
    ("%", "_modulo_"), (" ", ""), ("__", "_"),
]


def window_gradient_text(waveform: str) -> str:
    """Text of the power-window gradient of one waveform version."""
    steps = [("-0.2", 0), ("-0.1", 1), ("+0.1", 3), ("+0.2", 4)]
    terms = [
        f"{w}*({waveform}[][].fracPowerWindowEnds[{i}] - {waveform}[][].fracPowerWindowBegins[{i}])"
        for w, i in steps
    ]
    return "10.0*(" + " ".join(terms) + ")"


# Expressions that carry their own names.
NAMED_EXPRESSIONS = {
    window_gradient_text("coherent_filtered"): "coherent_filtered_fracPowerWindowGradient",
    window_gradient_text("deconvolved_filtered"): "deconvolved_filtered_fracPowerWindowGradient",
    "((TMath::Abs(peak[][].hwAngle) < TMath::Abs(peak[][].hwAngleXPol))*TMath::Abs(peak[][].hwAngle)"
    " + (TMath::Abs(peak[][].hwAngle) >= TMath::Abs(peak[][].hwAngleXPol))"
    "*TMath::Abs(peak[][].hwAngleXPol))": "minAbsHwAngle",
    "FFTtools::wrap(peak_phi - mc_phi, 360, 0)": "dPhi_mc",
    "peak_theta + mc_theta": "dTheta_mc",
    "FFTtools::wrap(peak_phi - wais_phi, 360, 0)": "dPhi_wais",
    "FFTtools::wrap(peak_phi - sun_phi, 360, 0)": "dPhi_sun",
    "floor(Iteration$/5)": "pol",
    "(Iteration$ % 5)": "peakInd",
    "((mc.weight > 0)*mc.weight + 1*(mc.weight==0))": "weight",
}


def mangle(text: str) -> str:
    for old, new in REPLACEMENTS:
        text = text.replace(old, new)
    return text.strip("_")


ALIASES = {mangle(text): name for text, name in NAMED_EXPRESSIONS.items()}


def branchify(text: str) -> str:
    """Column name for an expression, with the well-known expressions given short names."""
    plain = mangle(text)
    return ALIASES.get(plain, plain)


def branchify_column(text: Column) -> Column:
    """The same rule over a column of expression texts."""
    plain = F.btrim(reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REPLACEMENTS, text), F.lit("_"))
    pairs = [F.lit(x) for pair in ALIASES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), plain), plain)


def antenna_name(antenna, polarisation, sectors: int = 16) -> Column:
    """Sector number (from 1), ring letter and polarisation letter."""
    antenna, polarisation = col(antenna).cast("int"), col(polarisation).cast("int")
    ring = F.element_at(F.array(*[F.lit(r) for r in "TMB"]), F.floor(antenna / sectors).cast("int") + 1)
    pol = F.when(polarisation == 0, "H").otherwise("V")
    return F.concat((antenna % sectors + 1).cast("string"), ring, pol)


def bits_set(mask, width: int) -> Column:
    """How many of the lowest ``width`` bits are set."""
    return F.bit_count(col(mask).cast("long").bitwiseAND(F.lit((1 << width) - 1)))


def bit_at(mask, index) -> Column:
    return F.getbit(col(mask).cast("long"), col(index))


def min_bias(trigger_bits, adu5_bit: int = 1, soft_ext_bit: int = 3) -> Column:
    """GPS-timed or software/external trigger: the unbiased sample."""
    wanted = (1 << adu5_bit) | (1 << soft_ext_bit)
    return col(trigger_bits).cast("long").bitwiseAND(F.lit(wanted)) != 0


def swap_polarisation(pol) -> Column:
    return F.lit(1) - col(pol)


def count_percent(n, total) -> Column:
    """'12.00 (3.40%)'."""
    n, total = col(n).cast("double"), col(total).cast("double")
    return F.format_string("%.2f (%.2f%%)", n, F.try_divide(100.0 * n, total))
