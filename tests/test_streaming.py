from artifactlink.streaming import on_arrival
from tests.dexfix import Class, Method, archive, dex


def test_each_package_is_seen_once(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()

    def run():
        on_arrival(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, _: seen.extend(r.app for r in df.collect())).awaitTermination(120)

    (tmp_path / "in" / "a.apk").write_bytes(archive(**{"classes.dex": dex(Class("La;", methods=[Method("m")]))}))
    run()
    (tmp_path / "in" / "b.apk").write_bytes(archive(**{"classes.dex": dex(Class("Lb;", methods=[Method("m")]))}))
    run()
    assert seen == ["a.apk", "b.apk"]
