from plumbline.llm import decontam as D

ITEM = "John has 3 apples and buys 14 more at the market. How many apples does John have in total now?"
LONG = "Every morning John walks 7 miles to the harbour and sells 12 baskets of fish while Maria counts 9 boats from the pier"
SHORT = "we met Mary Ann Lee at the old stone bridge and then walked home"


def leaks(spark, docs, bench):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {r.doc_id: (r.kind, r.matched) for r in D.find_leaks(df, spark.createDataFrame([(0, bench)], "item_id long, text string")).collect()}


def test_a_literal_run_leaks_whatever_stands_after_it(spark):
    got = leaks(spark, [ITEM.replace("does John", "does Peter"), ITEM], ITEM)
    assert got[0][1] >= D.RUN and got[1][0] == "exact"


def test_values_of_other_lengths(spark):
    other = LONG.replace("7", "twenty five").replace("12", "two hundred").replace("9", "thirty one").replace("John", "Mary Ann").replace("Maria", "Jo Beth Lee")
    got = leaks(spark, [other, LONG, LONG.replace("7", "8"), "Every morning somebody walks a long way to the harbour and sells his fish"], LONG)
    assert got[0][0] == "reparameterised" and got[1][0] == "exact" and got[2][0] == "reparameterised" and 3 not in got


def test_runs_of_names_still_count_as_tokens(spark):
    item = SHORT + " past the mill and over the hill until the rain began to fall on us all that night in spring"
    got = leaks(spark, [SHORT + " alone"], item)
    assert got[0] == ("exact", 10)
