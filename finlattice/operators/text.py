"""News titles, industries and replies: ordered keyword rules as native expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_json

# News categories and their words, tried in this order.
CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("宏观", ("央行", "货币政策", "降息", "降准", "gdp", "cpi", "ppi", "社融", "m2", "利率")),
    ("政策", ("证监会", "银保监会", "财政部", "发改委", "政策", "监管")),
    ("行业", ("新能源", "半导体", "芯片", "人工智能", "ai", "医药", "消费", "房地产")),
    ("公司", ("财报", "业绩", "营收", "利润", "上市", "融资")),
    ("全球", ("美联储", "美元", "原油", "黄金", "美股", "欧股", "地缘")),
)

# Fund industries and their words.
FUND_INDUSTRIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("新能源", ("光伏", "锂电", "储能", "电动车", "新能源汽车", "锂电池", "太阳能", "风电", "核电", "氢能")),
    ("半导体", ("芯片", "集成电路", "AI", "算力", "半导体", "晶圆", "芯片", "GPU", "CPU", "传感器")),
    ("医药", ("创新药", "医疗器械", "中药", "生物医药", "疫苗", "医疗服务", "医药", "制药", "CRO", "CXO")),
    ("消费", ("白酒", "食品饮料", "零售", "家电", "纺织服装", "餐饮", "旅游", "酒店", "免税")),
    ("金融", ("银行", "保险", "券商", "信托", "租赁", "担保", "金融科技", "FinTech")),
    ("军工", ("航空航天", "船舶", "军工", "国防", "导弹", "无人机", "卫星", "雷达")),
    ("TMT", ("互联网", "软件", "云服务", "游戏", "传媒", "通信", "5G", "数据中心")),
    ("基建", ("建筑", "建材", "工程机械", "房地产", "园林", "装饰", "建筑设计", "装配式建筑")),
    ("农业", ("种植", "养殖", "农林牧渔", "种子", "饲料", "农药", "化肥", "农产品")),
    ("化工", ("石化", "化工新材料", "精细化工", "化学制品", "塑料", "橡胶", "纤维")),
)

# News industries in the order of their codes (I001 to I020), and their words.
NEWS_INDUSTRIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("新能源汽车", ("新能源汽车", "电动车", "锂电池", "比亚迪", "特斯拉", "宁德时代", "动力电池", "充电桩")),
    ("半导体", ("半导体", "芯片", "集成电路", "光刻机", "晶圆", "中芯国际", "华为芯片", "AI芯片")),
    ("医药生物", ("医药", "生物", "疫苗", "创新药", "医疗器械", "中药", "恒瑞医药", "集采")),
    ("食品饮料", ("食品", "饮料", "白酒", "茅台", "伊利", "海天味业", "乳制品", "消费")),
    ("房地产", ("房地产", "房价", "地产", "万科", "恒大", "限购", "房贷", "土地")),
    ("银行", ("银行", "金融", "利率", "存款", "贷款", "理财", "央行", "货币政策")),
    ("保险", ("保险", "保费", "险资", "寿险", "财险", "保险资金")),
    ("证券", ("证券", "券商", "A股", "IPO", "牛市", "印花税", "注册制")),
    ("军工", ("军工", "国防", "航天", "航空", "船舶", "导弹", "军费")),
    ("新能源", ("光伏", "风电", "太阳能", "绿电", "碳中和", "储能", "隆基绿能")),
    ("有色金属", ("有色", "铜", "铝", "黄金", "白银", "稀土", "锂矿")),
    ("化工", ("化工", "石化", "炼油", "化工原料", "万华化学", " PTA")),
    ("机械设备", ("机械", "设备", "工程机械", "工业机器人", "数控机床", "三一重工")),
    ("交通运输", ("航空", "航运", "港口", "铁路", "公路", "物流", "快递")),
    ("电子", ("电子", "消费电子", "手机", "苹果", "华为", "面板", "立讯精密")),
    ("计算机", ("计算机", "软件", "云计算", "AI", "人工智能", "大数据", "网络安全")),
    ("通信", ("通信", "5G", "运营商", "中国移动", "华为", "中兴通讯")),
    ("传媒", ("传媒", "影视", "游戏", "广告", "短视频", "字节跳动", "腾讯")),
    ("零售", ("零售", "电商", "拼多多", "京东", "阿里巴巴", "百货", "免税")),
    ("宏观", ("GDP", "CPI", "PMI", "社融", "M2", "财政", "降准", "降息", "美联储", "美元指数")),
)


# Tags of funds by the names of their holdings, and their words.
HOLDING_TAGS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("新能源", ("宁德时代", "比亚迪", "隆基绿能", "光伏", "储能", "锂电池", "新能源车")),
    ("半导体", ("中芯国际", "北方华创", "立讯精密", "芯片", "半导体", "集成电路")),
    ("医药", ("恒瑞医药", "药明康德", "迈瑞医疗", "医药", "医疗器械", "创新药")),
    ("消费", ("贵州茅台", "五粮液", "伊利股份", "美的", "消费", "白酒", "食品")),
    ("金融", ("中国平安", "招商银行", "兴业银行", "银行", "保险", "证券")),
    ("互联网", ("腾讯", "阿里", "美团", "字节", "互联网", "软件")),
    ("港股", ("腾讯控股", "阿里巴巴", "美团", "快手", "港股")),
    ("银行", ("工商银行", "建设银行", "农业银行", "招商银行", "银行")),
    ("军工", ("中国航发", "中航沈飞", "军工", "航天", "航空")),
)


def news_codes(spark: SparkSession) -> DataFrame:
    """(industry, industry_code) of the news industries."""
    return spark.createDataFrame([(name, f"I{i:03d}") for i, (name, _) in enumerate(NEWS_INDUSTRIES, 1)], "industry string, industry_code string")


def holds(text: Column, word: str) -> Column:
    return F.coalesce(F.contains(text, F.lit(word)), F.lit(False))


def first_category(text: Column, categories=CATEGORIES, default: str = "general") -> Column:
    """The first category with a word in the text, whatever the case."""
    low, out = F.lower(text), None
    for name, words in categories:
        hit = F.lit(False)
        for w in words:
            hit = hit | holds(low, w.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def classify(title: Column, content: Column, industries, hit: float = 0.7, miss: float = 0.3, other: str = "其他") -> Column:
    """(industry, confidence): the first industry with a word in title or content."""
    name = first_category(F.concat_ws(" ", title, content), industries, other)
    return F.struct(name.alias("industry"), F.when(name == other, miss).otherwise(hit).alias("confidence"))


def industry_scores(text: Column, industries=FUND_INDUSTRIES) -> Column:
    """An array of (score, rank, industry): how many of each industry's words the text holds, best first."""
    rows = [F.struct((-sum((holds(text, w).cast("int") for w in words), F.lit(0))).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("industry")) for i, (name, words) in enumerate(industries)]
    return F.filter(F.array_sort(F.array(*rows)), lambda r: r["minus"] < 0)


def top_industries(df: DataFrame, text: Column, id_: str = "fund_code", industries=FUND_INDUSTRIES, n: int = 3) -> DataFrame:
    """(id, industry, score, confidence) of each id's n best industries; confidence min(95, score / best * 50 + 50)."""
    best = df.select(id_, F.slice(industry_scores(text, industries), 1, n).alias("s"))
    rows = best.select(id_, (-F.col("s")[0]["minus"]).alias("_max"), F.explode("s").alias("r"))
    score = -F.col("r.minus")
    return rows.select(id_, F.col("r.industry").alias("industry"), score.alias("score"), F.least(F.lit(95.0), score / F.col("_max") * 50 + 50).alias("confidence"))


def with_code(df: DataFrame, codes: DataFrame, industry: str = "industry", unknown: str = "I000") -> DataFrame:
    """Adds industry_code from a table of a few dozen industries."""
    return df.join(codes.select(F.col("industry").alias(industry), "industry_code"), industry, "left").withColumn("industry_code", F.coalesce("industry_code", F.lit(unknown)))


def parse_classification(reply: Column) -> Column:
    """(industry, industry_code, confidence) from a model's reply, with defaults where it holds none."""
    p = first_json(reply, "industry string, industry_code string, confidence double")
    return F.struct(F.coalesce(p["industry"], F.lit("其他")).alias("industry"), F.coalesce(p["industry_code"], F.lit("I000")).alias("industry_code"), F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence"))


def parse_advice(reply: Column) -> Column:
    p = first_json(reply, "action string, confidence double, reason string")
    return F.struct(F.coalesce(p["action"], F.lit("hold")).alias("action"), F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(p["reason"], F.lit("")).alias("reason"))


def digest(df: DataFrame, day: str, title: str, order: str, top: int = 5) -> DataFrame:
    """A row for each day: count, the first titles joined, and a bullish, bearish or neutral verdict by words."""
    up, down = ("上涨", "利好", "增长", "突破"), ("下跌", "利空", "下滑", "风险")

    def count(words: tuple[str, ...]) -> Column:
        return sum((holds(F.col(title), w).cast("int") for w in words), F.lit(0))

    rows = df.withColumns({"_up": count(up), "_down": count(down)})
    # of all titles of a day only the smallest `top` by order are carried between tasks
    ranked = rows.groupBy(day).agg(F.count("*").alias("news_count"), F.sum("_up").alias("up"), F.sum("_down").alias("down"))
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(day).orderBy(order))).where(F.col("_rank") <= top)
    heads = first.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("_rank", F.col(title).alias("t")))).alias("_h")).select(day, F.array_join(F.transform("_h", lambda h: h["t"]), "；").alias("summary"))
    return ranked.join(heads, day).withColumn("market_impact", F.when(F.col("up") > F.col("down"), "bullish").when(F.col("up") < F.col("down"), "bearish").otherwise("neutral"))


def dedup_news(df: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """The first row of each URL; rows without one go."""
    w = Window.partitionBy(url).orderBy(seq)
    return df.where(F.col(url) != "").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ask_model(df: DataFrame, prompt: Column, client, reply: str = "reply") -> DataFrame:
    """Adds the replies of a pluggable client (a function from a list of prompts to a list of replies), batch by batch."""
    @F.arrow_udf("string")
    def ask(prompts: pa.Array) -> pa.Array:
        return pa.array(client(prompts.to_pylist()), pa.string())

    return df.withColumn(reply, ask(prompt))
