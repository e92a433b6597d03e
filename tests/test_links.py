from cleanlake.operators import links


def test_every_outcome(table):
    def file(i, context, component, area="content"):
        return (i, "h", context, component, area, 3, "/p/", "n.pdf", 1, 1, "x", 0, 0)

    files = table(
        "files",
        [
            file(1, 99, "backup", "course"),
            file(2, 1, "mod_resource"),
            file(3, 1, "mod_mod_x"),
            file(4, 2, "mod_folder"),
            file(5, 3, "mod_folder"),
            file(6, 99, "mod_folder"),
            file(7, 1, "backup", "other"),
        ],
    )
    context = table("context", [(1, 70, 11), (2, 70, 12), (3, 50, 11)])
    cm = table("course_modules", [(11, 5, 1, 1, 1, 0)])
    got = {r.id: (r.status, r.view_url) for r in links.resolve_links(files, context, cm).collect()}
    assert got == {
        1: ("restore", "/backup/restorefile.php?contextid=99"),
        2: ("section", "/course/view.php?id=5#module-11"),
        3: ("view", "/mod/x/view.php?id=11"),
        4: ("nomodule", None),
        5: ("unknowncontext", None),
        6: ("nocontext", None),
        7: ("view", "/mod/backup/view.php?id=11"),
    }
    row = links.resolve_links(files, context, cm).where("id = 2").first()
    assert row.download_path == "/1/mod_resource/content/3/p/n.pdf"
    assert row.download_name == "n.pdf"


def test_stored_download(table):
    paths = table("ghost_registry", [(1, "filedir/ab/cd/abcd", "x", 1)])
    assert tuple(links.stored_download(paths, "/data/").first()) == (
        "filedir/ab/cd/abcd",
        "/data/filedir/ab/cd/abcd",
        "abcd",
    )
