"""Driver-side constants: moments of the normal law, kernel weights, quantiles."""

from __future__ import annotations

import math
from statistics import NormalDist

#: The variance constants of the linear jump test by integrated-variance estimator.
THETA = {"RV": 2.0, "BV": math.pi**2 / 4 + math.pi - 3, "rMedRVar": 2.96, "rMinRVar": 3.81}
#: Fixed value: the scale of tripower quarticity as it is coded.
TRIPOWER = 0.8308609
#: The names of each kernel.
KERNEL_NAMES = {
    "bartlett": ("bartlett", "triangular"),
    "parzen": ("parzen",),
    "qs": ("qs", "quadratic"),
    "tukey": ("tukey", "hanning", "tukeyhanning"),
    "cubic": ("cubic",),
    "order5": ("5th", "5", "fifth"),
    "order6": ("6th", "6"),
    "order7": ("7th", "7"),
    "order8": ("8th", "8"),
    "parzenpoly": ("parzenpoly",),
    "tukeypoly": ("tukeypoly",),
    "flattop": ("flattop",),
}
#: The kernel names as they are listed.
LISTED_KERNELS = [
    "bartlett", "triangular", "parzen", "qs", "quadratic", "tukey", "hanning", "tukey-hanning", "cubic", "5th", "fifth",
    "6th", "7th", "8th", "parzen_poly", "tukey_poly", "flat-top", "flattop",
]
#: Polynomial coefficients, by power of x from 0, of the kernels that are plain polynomials.
POLYNOMIALS = {
    "bartlett": (1, -1),
    "cubic": (1, 0, -3, 2),
    "order5": (1, 0, -10, 15, -6),
    "order6": (1, 0, -15, 35, -21),
    "order7": (1, 0, -21, 70, -84, 35),
    "order8": (1, 0, -28, 126, -210, 120),
}


def mu_p(p: float) -> float:
    """The p-th absolute moment of a standard normal variable."""
    return 2 ** (p / 2) * math.gamma((p + 1) / 2) / math.sqrt(math.pi)


def gfunction(x: float) -> float:
    return min(x, 1 - x)


def psi_constants(kn: int) -> tuple[float, float]:
    """Scaled sums of the squared steps and of the squares of g over j / kn, j = 0 .. kn."""
    g = [gfunction(j / kn) for j in range(kn + 1)]
    return kn * sum((b - a) ** 2 for a, b in zip(g, g[1:])), sum(x * x for x in g[:-1]) / kn


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def kernel_id(name: str) -> str:
    """The canonical kernel of a name; case, hyphens and underscores do not matter."""
    plain = name.lower().replace("-", "").replace("_", "")
    for kernel, names in KERNEL_NAMES.items():
        if plain == kernel or plain in names:
            return kernel
    raise ValueError(f"unknown kernel {name!r}; known: {list_available_kernels()}")


def list_available_kernels() -> list[str]:
    return list(LISTED_KERNELS)


def kernel_weight(x: float, kernel: str) -> float:
    k = kernel_id(kernel)
    if k in POLYNOMIALS:
        return float(sum(c * x**i for i, c in enumerate(POLYNOMIALS[k])))
    if k.startswith("parzen"):
        return 1 - 6 * x**2 + 6 * x**3 if x < 0.5 else 2 * (1 - x) ** 3
    if k.startswith("tukey"):
        return (1 + math.cos(math.pi * x)) / 2
    if k == "qs":
        a = 6 * math.pi * x / 5
        return 1.0 if x == 0 else 25 / (12 * math.pi**2 * x**2) * (math.sin(a) / a - math.cos(a))
    return 1.0 if x < 0.1 else (1 - x) / 0.9  # flattop
