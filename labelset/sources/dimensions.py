"""Inline dimension tables of the evaluated study (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The models, scenarios, display labels and report files of the study.
# ---------------------------------------------------------------------------
MODELS: tuple[str, ...] = (
    "meta-llama-3.1-8b.Q4_K_M:latest",
    "llama3.1:8b",
)

SCENARIOS: tuple[tuple[str, str, str, str], ...] = (
    ("attr_streaming_mix", "Mídia/Publisher & Streaming", "Atribuição & Mix de Canais",
     "otimizar o mix de canais para contribuição real e elevar ROAS em 15%"),
    ("ads_telecom_cac", "Telecom & Internet", "Aquisição de Tráfego",
     "reduzir o CAC em 20% mantendo volume de novos clientes"),
    ("brand_fintech_roas", "Fintech", "Marca & Awareness",
     "aumentar o ROAS em 30% sem perder volume de impressões"),
    ("crm_ong_donativos", "Governamental / ONG", "CRM & Mensageria",
     "crescer doações recorrentes em 25% e reduzir churn de doadores em 15%"),
    ("pricing_ondemand_ticket", "Apps on-demand", "Pricing & Receita",
     "elevar o ticket médio em 12% sem reduzir a taxa de conversão"),
    ("onboarding_imob_d7", "Imobiliário / Portais de leads", "Ativação & Onboarding",
     "melhorar a ativação no D7 em 5 p.p."),
    ("retencao_saasb2b_churn", "SaaS B2B", "Retenção",
     "reduzir o churn mensal em 2 p.p. mantendo NPS >= 60"),
    ("growth_saasb2c_trialpaid", "SaaS B2C", "App Growth & Mobile",
     "aumentar conversão de trial para pago em 25% com payback < 6 meses"),
    ("comun_marketplace_ret30", "Marketplace", "Conteúdo & Comunidade",
     "elevar retenção 30 dias para 45%"),
    ("cs_saude_csat_fcr", "Saúde Digital / Telemedicina", "Suporte & Experiência do Cliente",
     "aumentar CSAT para 90% e reduzir recontatos (FCR +15 p.p.)"),
    ("app_educacao_conv", "Educação", "App Growth & Mobile",
     "aumentar conversão de onboarding em 20% e reduzir bounce em 10%"),
    ("omni_telecom_sla", "Telecom & Internet", "Omnichannel & Offline Impact",
     "atribuir vendas offline e manter SLA de atendimento < 2 min no chat"),
    ("devops_auto_uptime", "marketplace automotivo", "engenharia/DevOps",
     "elevar uptime para 99,95% e reduzir MTTR em 20%"),
    ("risco_mobilidade_fraude", "mobilidade urbana", "compliance & risco",
     "reduzir o tempo de resolução de fraudes em 25% mantendo FPR < 3%"),
    ("crm_agritech_reativacao", "agritech de insumos", "CRM/lifecycle",
     "elevar reativação 30d em 15% e reduzir unsubscribe em 20%"),
    ("ops_logtech_otif", "logtech (3PL)", "operações/logística",
     "aumentar OTIF em 8 p.p. e reduzir custo por pedido em 12%"),
    ("prod_moda_entregab", "e-commerce de moda", "produto/experiência",
     "elevar entregabilidade de e-mail para 98% e reduzir bounces < 1%"),
    ("crm_hotel_forecast", "hospitalidade (hotéis)", "CRM/lifecycle",
     "melhorar acurácia de previsão de demanda para > 85%"),
    ("prod_eventos_rsvp", "plataforma de eventos", "produto/experiência",
     "aumentar taxa de RSVP confirmado em 20% via e-mail/push"),
    ("people_conteudo_turnover", "plataforma de conteúdo", "RH/People",
     "reduzir turnover em 3 p.p. mantendo time-to-hire <= 30 dias"),
    ("perfsec_saas_mrr", "SaaS de cibersegurança", "marketing de performance",
     "crescer MRR em 10% elevando MQL rate em 15% com CPL estável"),
    ("sales_edcorp_cac", "educação corporativa", "vendas (inside sales)",
     "reduzir CAC em 15% mantendo win rate >= 25%"),
    ("sales_gaming_checkout", "gaming mobile", "vendas (inside sales)",
     "aumentar conversão de checkout em 15% sem reduzir ARPPU"),
    ("crm_solar_churn90", "energia solar distribuída", "CRM/lifecycle",
     "reduzir churn em 90 dias em 2 p.p. e elevar CTR em 20%"),
    ("ads_imob_cpl", "Imobiliário / Portais de leads", "Aquisição de Tráfego",
     "reduzir CPL em 20% preservando taxa de qualificação >= 35%"),
)

# Display label per model; an empty model name in a report is shown as the base label.
MODEL_LABELS: dict[str, str] = {
    "meta-llama-3.1-8b.Q4_K_M:latest": "llama3.1:trained",
    "llama3.1:8b": "llama3.1:base",
}
DEFAULT_REPORT_LABEL = "llama3.1:base"

# Run label -> report file.
REPORT_FILES: dict[str, str] = {
    "trained_no_wcap": "eval_results__meta_llama_3_1_8b_Q4_K_M_latest.json",
    "baseline_no_wcap": "eval_results__llama3_1_8b.json",
    "trained_wcap": "eval_results_wcap__meta_llama_3_1_8b_Q4_K_M_latest.json",
    "baseline_wcap": "eval_results_wcap__llama3_1_8b.json",
}
RESULT_FILES: tuple[str, ...] = ("results.json", "results_wcap.json")

CONDITIONS: tuple[str, ...] = ("unlimited", "limited")


def scenarios_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(SCENARIOS)],
                                 "scenario_pos int, id string, nicho string, area string, objetivo string")


def models_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(MODELS)], "model_pos int, model string")


def labels_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_LABELS.items()), "model string, label string")
