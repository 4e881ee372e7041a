import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif("LODESTAR_WITHOUT" in os.environ, reason="this is the copy")
def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and passes its own quick tests."""
    for name in ("lodestar", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'funnel_by_source' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    # other folders stay, as packages may be found by them; this checkout must not
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    env = os.environ | {"LODESTAR_WITHOUT": "1", "PYTHONPATH": os.pathsep.join(paths)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    # the catalogue against SQL, one query of each area, and unit tests of each folder
    some = "catalogue and (entry or funnel or merge or voxel_pool or pinhole or log_reduce or csv_round_trip) or test_merge or test_select or test_ragged or test_further or test_completions"
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider", "-k", some], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]
