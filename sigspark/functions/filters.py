"""Filter design, and one linear filter as a state-space system that runs in blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class System:
    """z' = A z + B x, y = C z + D x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def order(self) -> int:
        return len(self.b)

    def steady(self) -> np.ndarray:
        """The state that an endless input of ones leads to."""
        return np.linalg.solve(np.eye(self.order) - self.a, self.b)

    def run(self, x: np.ndarray, z: np.ndarray, part: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and last state for inputs ``x`` (samples x channels) from state ``z`` (order x channels).

        Inputs go through in parts: within a part the outputs are a product with fixed matrices, and only the
        state passes from part to part.
        """
        n, channels = x.shape
        y, z = np.empty_like(x, dtype=np.float64), z.astype(np.float64).copy()
        powers, sees, direct, drives = self._parts(part)
        for begin in range(0, n, part):
            u = x[begin : begin + part]
            m = len(u)
            y[begin : begin + m] = direct[:m, :m] @ u + sees[:m] @ z
            z = powers[m] @ z + drives[:, part - m :] @ u
        return y, z

    def _parts(self, part: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The matrices that take a part's inputs and state to its outputs and next state; made once."""
        known = self.__dict__.get("_known", {})
        if part in known:
            return known[part]
        powers = [np.eye(self.order)]
        for _ in range(part):
            powers.append(self.a @ powers[-1])
        sees = np.array([self.c @ p for p in powers[:part]])
        pulse = np.concatenate([[self.d], [self.c @ p @ self.b for p in powers[: part - 1]]])
        lag = np.subtract.outer(np.arange(part), np.arange(part))
        direct = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
        drives = np.array([p @ self.b for p in powers[:part]][::-1]).T
        object.__setattr__(self, "_known", known | {part: (powers, sees, direct, drives)})
        return self._known[part]

    def advance(self, n: int) -> np.ndarray:
        """What ``n`` samples without input do to a state."""
        return np.linalg.matrix_power(self.a, n)


def from_coefficients(b, a) -> System:
    """A transfer function; the state is that of the transposed direct form II."""
    a, b = np.atleast_1d(np.asarray(a, float)), np.atleast_1d(np.asarray(b, float))
    n = max(len(a), len(b), 2)
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    shift = np.eye(n - 1, k=1)
    shift[:, 0] -= a[1:]
    return System(shift, b[1:] - a[1:] * b[0], np.eye(n - 1)[0], float(b[0]))


def chain(systems: list[System]) -> System:
    """Systems one behind the other, as one."""
    whole = systems[0]
    for s in systems[1:]:
        top = np.hstack([whole.a, np.zeros((whole.order, s.order))])
        low = np.hstack([np.outer(s.b, whole.c), s.a])
        whole = System(np.vstack([top, low]), np.concatenate([whole.b, s.b * whole.d]), np.concatenate([s.d * whole.c, s.c]), s.d * whole.d)
    return whole


def butter_bandpass(order: int, low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a Butterworth band-pass with 2 * order poles."""
    if not 0 < low < high < fs / 2:
        raise ValueError("0 < low < high < fs / 2 is needed")
    lowpass = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order))
    w1, w2 = (4 * np.tan(np.pi * f / fs) for f in (low, high))  # warped for a bilinear transform at rate 2
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    half = lowpass * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    gain = width**order * np.real(4.0**order / np.prod(4 - poles))
    zeros = np.concatenate([np.ones(order), -np.ones(order)])  # at frequency zero, and at the top
    return gain * np.real(np.poly(zeros)), np.real(np.poly((4 + poles) / (4 - poles)))


def notch(frequency: float, quality: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * np.pi * frequency / fs
    g = 1 / (1 + np.tan(w / quality / 2))
    return g * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * g * np.cos(w), 2 * g - 1])


def chebyshev_lowpass(order: int, ripple: float, edge: float) -> System:
    """Chebyshev filter of type I, in sections of two poles; ``edge`` as a share of half the sampling rate."""
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    poles = -np.sinh(mu + 1j * np.pi * np.arange(1 - order, order, 2) / (2 * order))
    poles = poles * 4 * np.tan(np.pi * edge / 2)
    z = (4 + poles) / (4 - poles)
    level = 1 / np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0
    sections = []
    for p in z[z.imag > 1e-12]:
        a = np.array([1, -2 * p.real, abs(p) ** 2])
        sections.append(from_coefficients(a.sum() / 4 * np.array([1, 2, 1]), a))
    for p in z[abs(z.imag) <= 1e-12]:
        sections.append(from_coefficients((1 - p.real) / 2 * np.array([1, 1]), [1, -p.real]))
    sections[0] = System(sections[0].a, sections[0].b, sections[0].c * level, sections[0].d * level)
    return chain(sections)


def windowed_sinc(taps: int, cutoff: float, fs: float) -> np.ndarray:
    """A low-pass by a Hamming-windowed sinc, of gain one at frequency zero."""
    i = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff / fs * np.sinc(2 * cutoff / fs * i) * np.hamming(taps)
    return h / h.sum()
