from lociweave.llm import html_extract as h


def test_shards_do_not_change_what_repeats(spark):
    # Three pages of a host over two shards: of ten hosts most have two pages in one and one in the other.
    boiler = "all rights reserved by the owner of this site and its partners"
    rows = [(10 * s + k, f"http://h{s}.org/{k}", f"<body><div>{boiler}</div><div>only on {' '.join(f'h{s}v{k}x{j}' for j in range(7))}</div></body>") for s in range(10) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, two = ({r.id: r.text for r in h.extract(df, shard_pages=n).collect()} for n in (500, 2))
    assert all(boiler not in t for t in one.values())
    assert two == one


def test_a_repeat_within_one_page_is_no_repeat_over_shards(spark):
    own = "these seven words are said twice here"
    rows = [(k, f"http://x.org/{k}", f"<body><div>{own} page{k} {own} {' '.join(f'v{k}x{j}' for j in range(7))}</div></body>".replace("these", f"these{k}").replace("seven", f"seven{k}").replace("are", f"are{k}").replace("twice", f"twice{k}")) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, two = ({r.id: r.text for r in h.extract(df, shard_pages=n).collect()} for n in (500, 2))
    assert two == one
