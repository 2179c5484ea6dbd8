"""Rule labels as CASE expressions. Texts and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(c: Column, rules: list[tuple[Column, str]], otherwise: str) -> Column:
    head, *tail = rules
    out = F.when(*head)
    for condition, label in tail:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def operation_size(amount: Column) -> Column:
    return (
        F.when(amount <= 50_000, "Pequena")
        .when(amount <= 500_000, "Média")
        .when(amount <= 5_000_000, "Grande")
        .when(amount > 5_000_000, "Muito Grande")
        .otherwise("Não Classificada")
    )


def market_share_class(share_pct: Column) -> Column:
    return _steps(
        share_pct,
        [(share_pct >= 10, "Líder"), (share_pct >= 5, "Grande"), (share_pct >= 1, "Média")],
        "Pequena",
    )


def market_concentration(hhi: Column) -> Column:
    return _steps(
        hhi,
        [
            (hhi < 0.15, "Mercado não concentrado"),
            (hhi < 0.25, "Mercado moderadamente concentrado"),
        ],
        "Mercado altamente concentrado",
    )


def territorial_concentration(hhi: Column) -> Column:
    return _steps(
        hhi, [(hhi < 0.15, "Baixa concentração"), (hhi < 0.25, "Concentração moderada")],
        "Alta concentração",
    )


def competition(hhi: Column, cr4: Column) -> Column:
    return _steps(
        hhi,
        [
            ((hhi > 0.25) & (cr4 > 0.6), "Mercado oligopolizado - poucas empresas dominam"),
            ((hhi > 0.15) | (cr4 > 0.4), "Mercado moderadamente concentrado"),
        ],
        "Mercado competitivo com boa distribuição",
    )


def regional_risk(index: Column) -> Column:
    return _steps(index, [(index > 0.5, "Alto"), (index > 0.25, "Médio")], "Baixo")


def accessibility(distance_km: Column) -> Column:
    return _steps(
        distance_km,
        [
            (distance_km < 100, "Muito Acessível"),
            (distance_km < 300, "Acessível"),
            (distance_km < 600, "Moderadamente Acessível"),
        ],
        "Remoto",
    )


def hotspot(score: Column, p70: Column, p85: Column, p95: Column) -> Column:
    return _steps(
        score, [(score >= p95, "Very Hot"), (score >= p85, "Hot"), (score >= p70, "Warm")], "Cold"
    )


def correlation(r: Column) -> Column:
    size = F.abs(r)
    direction = F.when(r > 0, "positiva").otherwise("negativa")
    strength = _steps(
        size,
        [
            (size < 0.1, "muito fraca"), (size < 0.3, "fraca"),
            (size < 0.5, "moderada"), (size < 0.7, "forte"),
        ],
        "muito forte",
    )
    return F.when(r.isNotNull(), F.concat_ws(" ", F.lit("Correlação"), direction, strength))


def diversification(n_substances: Column) -> Column:
    return (
        F.when((n_substances > 0) & (n_substances <= 1), "Especializada")
        .when((n_substances > 1) & (n_substances <= 3), "Pouco Diversificada")
        .when((n_substances > 3) & (n_substances <= 5), "Diversificada")
        .when(n_substances > 5, "Muito Diversificada")
    )


def simple_moran(i: Column) -> Column:
    return _steps(
        i,
        [
            (i > 0.1, "Autocorrelação espacial positiva (clustering)"),
            (i < -0.1, "Autocorrelação espacial negativa (dispersão)"),
        ],
        "Distribuição espacial aleatória",
    )


def detailed_moran(i: Column, p_value: Column) -> Column:
    pattern = _steps(
        i,
        [(i > 0.1, "clustering espacial positivo"), (i < -0.1, "dispersão espacial")],
        "distribuição espacial aleatória",
    )
    significance = F.when(p_value < 0.05, "significativo").otherwise("não significativo")
    return F.format_string("%s (%s, p=%.3f)", pattern, significance, p_value)


def geary(c: Column) -> Column:
    return _steps(
        c,
        [(c < 1, "Autocorrelação espacial positiva"), (c > 1, "Autocorrelação espacial negativa")],
        "Sem autocorrelação espacial",
    )


def anomaly_impact(anomalous: Column, share: Column) -> Column:
    return (
        F.when(anomalous == 0, "Baixo impacto - poucas anomalias detectadas")
        .when(share.isNull(), "Não foi possível calcular impacto")
        .when(share > 0.5, "Alto impacto - anomalias representam mais de 50% do CFEM total")
        .when(share > 0.2, "Médio impacto - anomalias representam 20-50% do CFEM total")
        .otherwise("Baixo impacto - anomalias representam menos de 20% do CFEM total")
    )


def model_reliability(test_r2: Column) -> Column:
    return _steps(
        test_r2,
        [(test_r2 > 0.8, "Alta confiabilidade"), (test_r2 > 0.6, "Média confiabilidade")],
        "Baixa confiabilidade - modelo precisa ser refinado",
    )


def dispersion(index: Column) -> Column:
    return _steps(
        index,
        [
            (index > 1.5, "Operações altamente dispersas geograficamente"),
            (index > 1.0, "Operações moderadamente dispersas"),
        ],
        "Operações geograficamente concentradas",
    )


def cluster_count(n: Column) -> Column:
    return (
        F.when(n > 5, F.format_string("Identificados %d clusters espaciais distintos", n))
        .when(n > 0, F.format_string("Poucas concentrações espaciais (%d clusters)", n))
        .otherwise("Sem padrões de agrupamento espacial")
    )


def mean_distance(km: Column) -> Column:
    return _steps(
        km,
        [
            (km > 500, "Operações predominantemente em áreas remotas"),
            (km > 200, "Operações em áreas de média acessibilidade"),
        ],
        "Operações em áreas de boa acessibilidade",
    )
