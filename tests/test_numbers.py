"""Numeric integrity: families of expressions, comparison steps, growth with the text."""

import time

import pytest

from scriptorium.functions import numbers

CASES = [
    ("Q3 revenue was 2.5 billion", "第三季度收入25亿", "ok"),
    ("twenty-five percent in 2020", "2020年百分之二十五", "ok"),
    ("three million users", "三百万用户", "ok"),
    ("March 5, 1,200 people", "3月5日，1200人", "ok"),
    ("in Q1", "第二季度", "error"),
    ("it costs 10 dollars", "价格是12美元", "error"),
    ("a machine", "1台机器", "warning"),
    ("nearly double, 7 now", "几乎翻倍，现在8个", "warning"),
    (None, "", "ok"),
    ("Sales rose 10-15%, or 500-1,000 cars.", "销量增长10%至15%，即500至1,000辆。", "ok"),
    ("It fell -5%.", "下降5%。", "error"),
    ("one hundred and five seats", "105个座位", "ok"),
    ("three to five million", "300万至500万", "warning"),
    ("the nineties", "90年代", "ok"),
    ("We shipped two things", "我们发了两件", "ok"),
    ("World Wars I and II", "一战和二战", "ok"),
    ("Output tripled.", "产量增长2倍。", "ok"),
    ("Output will double.", "产量将翻倍。", "ok"),
    ("He alone came.", "他一个人来了。", "warning"),
    ("He alone came.", "两个人来了。", "error"),
    ("Nov.25", "11月25日", "ok"),
    ("May I ask?", "我可以问吗？", "ok"),
    ("We met on May Parker's birthday.", "我们在梅·帕克生日那天见面。", "ok"),
    ("We met in May Parker Hall.", "我们5月在帕克厅见面。", "ok"),
    ("It may be 18 months.", "可能是18个月。", "ok"),
    ("They march to 977.", "他们走到977。", "ok"),
    ("Tens of thousands of people", "数万人", "ok"),
    ("Tens of thousands of people", "数千人", "error"),
    ("It cost $50-200 billion.", "耗资500亿至2000亿美元。", "warning"),
    ("We remove CO2.", "我们去除二氧化碳。", "ok"),
    ("The gas is CO2.", "是CO3。", "error"),
    ("helium-3", "氦-3", "ok"),
    ("Vic 20", "VIC-20", "ok"),
    ("It was -42.", "是42。", "error"),
    ("8 out of 10", "8分，满分10分", "ok"),
    ("an 10 out of 10 experience", "一次满分 10 分体验", "warning"),
    ("9 out of 10 experience", "满分 10 分体验", "error"),
    ("two million and we feel comfortable with 1.8", "", "warning"),
    ("a shot at 2 million, and we feel comfortable with 1.8.", "200 万辆，180 万辆", "ok"),
    ("a shot at 2 million, and we feel comfortable with 1.8.", "200 万辆，190 万辆", "error"),
    ("You can do it either way.", "两种方式都可以。", "warning"),
    ("You can do it either way.", "三种方式都可以。", "error"),
    ("triple digit increases", "3 位数的增长", "ok"),
    ("the first two quarters", "前两个季度", "ok"),
    ("third quarter in the plan", "计划中的第三个季度", "ok"),
    ("fourth consecutive profitable quarter", "连续第4个季度盈利", "ok"),
    ("in the same quarter", "同一个季度", "ok"),
    ("One billion users and half a million cars.", "10亿用户和50万辆汽车。", "ok"),
    ("Gen 2 satellites", "第二代卫星", "ok"),
    ("Gen 2 satellites", "第一代卫星", "error"),
    ("The zeroth law", "第零定律", "ok"),
    ("The zeroth law", "第一定律", "error"),
    ("one point one percent", "1.1%", "ok"),
    ("a buck 05", "1.05美元", "ok"),
    ("A 100th of the price.", "价格的1%。", "ok"),
    ("Six six or seven swing states.", "6个、6个或7个摇摆州。", "ok"),
    ("About 10 or 20,000 votes.", "大约10,000或20,000票。", "ok"),
    ("between flights", "两次飞行之间", "warning"),
    ("It is a form, a form of speech.", "这是一种，一种言论形式。", "warning"),
    ("three quarters of it", "四分之三", "ok"),
    ("three-quarters of it", "四分之三", "ok"),
    ("a quarter of it", "四分之一", "ok"),
    ("We brought a gigawatt online", "1吉瓦上线", "warning"),
    ("We brought power online", "1吉瓦上线", "error"),
    ("The First Amendment", "第一修正案", "ok"),
    ("5th Circuit Court", "第五巡回法院", "ok"),
    ("probably 100 or more", "可能10万以上", "warning"),
    ("probably 100 or more", "可能100万以上", "error"),
    ("in august 2026", "2026年8月", "ok"),
    ("On November 18", "十一月18日", "ok"),
    ("Top 10 trends on May 20th", "5月20日的十大趋势", "ok"),
    ("dual motor", "双电机", "ok"),
    ("The day before it opened", "开业前1天", "warning"),
    ("Two thousand hospitals.", "两千家医院。", "ok"),
    ("approaching $10 billion", "接近1000万美元", "error"),
    ("10 million users and 5 offices", "1000万用户", "error"),
    ("5k to 10k", "5000到10000", "ok"),
    ("the 10-K filing", "10-K文件", "ok"),
    ("The temperature is 100 kilowatt", "100千瓦", "ok"),
    ("Double click on it.", "详细说说。", "ok"),
    ("Double click on it. Production doubled.", "详细说说。产量增加了。", "error"),
    ("Wait until we have tens", "几十个", "ok"),
    ("4 20", "420", "warning"),
    ("One half century has passed.", "已经过去半个世纪。", "ok"),
    ("One half century has passed.", "已经过去一个世纪。", "error"),
    ("It costs 15 to $20,000", "1.5万至2万美元", "warning"),
    ("twenty-three dogs", "二十三只狗", "ok"),
    ("a hundred billion", "1000亿", "ok"),
    ("an order of magnitude", "1个数量级", "ok"),
    ("season two, episode four", "第二季第四集", "ok"),
]


@pytest.mark.parametrize("source, target, level", CASES)
def test_pairs(source, target, level):
    assert numbers.compare(source, target)[0] == level


READ = [
    ("from 10-15% to -5", ["-5", "10", "15"]),
    ("VIC-20, helium-3 and CO2", ["20", "3", "co2"]),
    ("$1,234.50 and .5", ["0.5", "1234.5"]),
    ("one hundred and five, twenty-three, two thousand", ["105", "2000", "23"]),
    ("three quarters, a quarter of it, two-thirds", ["1", "2", "3", "3", "4", "4"]),
    ("5k, 2.5bn, 7 grand and 10-K filings", ["10", "2500000000", "5000", "7000"]),
    ("Sept. 3, 2020 and 4 March", ["2020", "3", "3", "4", "9"]),
    ("It may be. I march. Feb said so.", []),
    ("twice, threefold, quadrupled", ["2", "3", "4"]),
    ("三百万、两千、二十三只、百分之五、四分之三", ["2000", "23", "3", "3000000", "4", "5"]),
    ("3.5万亿和12千瓦", ["12", "3500000000000"]),
    ("增长2倍，扩大三倍，翻倍", ["2", "3", "4"]),
    ("10, 20 or 30,000", ["10", "20", "30000"]),
    ("1, 234 stands for 1,234", ["1234", "1234"]),
    ("it was 1430 or something", ["14", "30"]),
    ("0", ["0"]),
    ("", []),
]


@pytest.mark.parametrize("text, values", READ)
def test_values(text, values):
    assert sorted(x.partition(":")[2] for x in numbers.tokens(text)) == sorted(values)


def test_quarters_are_no_numbers():
    assert numbers.tokens("Q1, 2Q, third quarter, season four, 第二季度") == ["quarter:1", "quarter:2", "quarter:2", "quarter:3", "quarter:4"]


def test_added_ones_need_as_many_wordings():
    assert numbers.compare("I met a man.", "我遇到一个人，1次。")[0] == "error"
    assert numbers.compare("I met a man and another man.", "我遇到一个人和一个人。")[0] == "warning"


def test_work_grows_with_the_text():
    text = "In 2020 the 5 to 6 million users of Q3 paid $1,234.50, about twenty-three percent more than on March 5. "
    seconds = []
    for times in (500, 4000):
        began = time.process_time()
        assert len(numbers.tokens(text * times)) == 8 * times
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * seconds[0] + 1  # eight times the text


def test_column(spark):
    rows = spark.createDataFrame([(1, "Q1 and 5", "第一季度和5"), (2, None, "7"), (3, "", None)], "id int, a string, b string")
    found = {r.id: r.r for r in rows.select("id", numbers.integrity("a", "b").alias("r")).collect()}
    assert found[1].level == "ok" and found[1].source_values == ["number:5", "quarter:1"]
    assert found[2].level == "error" and found[2].target_values == ["number:7"] and found[3].level == "ok"
