"""Unit conversions and closed-form quantities as Column expressions.

Missing is NULL everywhere; NaN never leaves an expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdframes import schema as S


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def density_g_cm3(mass_g_mol: Column, volume_A3: Column) -> Column:
    return F.try_divide(mass_g_mol, F.lit(S.AVOGADRO) * volume_A3 * F.lit(S.ANG3_TO_CM3))


def concentration_mol_dm3(n: Column, volume_A3: Column) -> Column:
    ok = (n >= 0) & finite(volume_A3).isNotNull() & (volume_A3 > 0)
    return F.when(ok, n.cast("double") / (F.lit(S.AVOGADRO) * volume_A3 * F.lit(S.ANG3_TO_DM3)))


def kinetic_temperature(kinetic_kcal_mol: Column, dof: Column) -> Column:
    """2K/(dof R); the usual dof is 3N-3."""
    return F.try_divide(F.lit(2.0) * kinetic_kcal_mol, dof * F.lit(S.GAS_CONSTANT_KCAL))


def box_length(mass_g_mol: Column, density: Column) -> Column:
    """Edge in A of the cubic box that holds the given molar mass at the density in g/cm3."""
    return F.cbrt(F.try_divide(mass_g_mol, F.lit(S.AVOGADRO * S.ANG3_TO_CM3) * density))


def slope_to_sigma(slope_A2_ns: Column, za, zb, volume_A3: Column, temperature_K: Column,
                   dimension: int = 3) -> Column:
    """Conductivity (S/m) carried by a displacement-correlation slope."""
    return (F.lit(S.E_CHARGE_C ** 2) * za * zb * (slope_A2_ns * F.lit(1.0e-11))
            / (F.lit(2.0 * dimension) * (volume_A3 * F.lit(1.0e-30))
               * F.lit(S.K_B_J_PER_K) * temperature_K))


def slope_to_diffusion_cm2_s(slope_A2_ns: Column, dimension: int = 3) -> Column:
    return slope_A2_ns * F.lit(1.0e-7) / F.lit(2.0 * dimension)


def nernst_einstein(n: Column, volume_A3: Column, d_m2_s: Column, charge: Column,
                    temperature_K: Column) -> dict[str, Column]:
    """Number density, molarity and conductivity; all NULL on invalid input."""
    ok = ((n > 0) & finite(volume_A3).isNotNull() & (volume_A3 > 0) & finite(d_m2_s).isNotNull()
          & finite(temperature_K).isNotNull() & (temperature_K > 0))
    nd = n / (volume_A3 * F.lit(1.0e-30))
    sigma = nd * charge * charge * F.lit(S.E_CHARGE_C ** 2) * d_m2_s / (F.lit(S.K_B_J_PER_K) * temperature_K)
    return {"number_density_m3": F.when(ok, nd),
            "concentration_mol_L": F.when(ok, nd / F.lit(S.AVOGADRO * 1000.0)),
            "sigma_NE_S_m": F.when(ok, sigma), "sigma_NE_mS_cm": F.when(ok, sigma * 10.0)}


def transference(dp: Column, dm: Column, lpp: Column, lmm: Column, lpm: Column,
                 zplus: float = 1.0, zminus: float = -1.0) -> dict[str, Column]:
    """Transference numbers from displacement slopes; NULL where a denominator is 0 or missing.

    Diffusion ratio, charge-weighted ratio, and the steady-state number of a 1:1 electrolyte.
    """
    sigma = F.lit(zplus * zplus) * lpp + F.lit(zminus * zminus) * lmm + F.lit(2.0 * zplus * zminus) * lpm
    monovalent = math.isclose(zplus, 1.0) and math.isclose(zminus, -1.0)
    steady = (F.try_divide(lpp - F.try_divide(lpm * lpm, lmm), sigma) if monovalent
              else F.lit(None).cast("double"))
    return {"PFG_t_app": F.try_divide(dp, dp + dm),
            "eNMR_t0": F.try_divide(F.lit(zplus) * (F.lit(zplus) * lpp + F.lit(zminus) * lpm), sigma),
            "Bruce_Vincent_tss": steady, "sigma_reduced": sigma}


def duration_bounds(n_frames: Column, dt: float, left: Column, right: Column) -> dict[str, Column]:
    """Shortest and longest lifetime compatible with n sampled frames; open if censored."""
    d = F.lit(float(dt))
    return {"duration_grid_ns": n_frames * d,
            "duration_lower_bound_ns": F.greatest(n_frames - 1, F.lit(0)) * d,
            "duration_upper_bound_ns": F.when(~left & ~right, (n_frames + 1) * d)}


def kww(time: Column, tau: Column, beta: Column, plateau: Column) -> Column:
    """Stretched exponential that decays from 1 to ``plateau``."""
    scaled = F.pow(F.greatest(time, F.lit(0.0)) / F.greatest(tau, F.lit(1.0e-30)), beta)
    return plateau + (F.lit(1.0) - plateau) * F.exp(-F.least(F.greatest(scaled, F.lit(0.0)), F.lit(700.0)))


def dt_ns(dt_ps: float | None = None, dt_ns: float | None = None, stride: int = 1) -> float:
    """Frame spacing in ns from either unit, times the frame stride."""
    if (dt_ps is None) == (dt_ns is None):
        raise ValueError("give exactly one of dt_ps and dt_ns")
    value = dt_ns if dt_ns is not None else dt_ps / 1000.0
    if value <= 0 or stride <= 0:
        raise ValueError("time step and stride must be positive")
    return value * stride
